"""HTML extraction: classes against brute force, templates, and what stays."""

import collections

from taxaspark.llm import html_extract as H

PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>home</a></li></ul></nav><div class='ad'>buy</div>{main}<aside>side</aside><footer>&copy; f</footer></body></html>"


def test_html_articles_and_templates(spark):
    main = "<article><h1>Title &amp; more</h1><p>one\n <b>two</b><br>three<p>four&#233;<form><input>no</form><div class='comments'><p>reader</p></div></article>"
    plain = "<div><h2>Head {0}</h2><p>Body {0} of some length</p></div>"
    pages = [(1, "http://a.com/1", PAGE.format(main=main)), (2, "http://a.com/2", None), (3, "http://a.com/3", ""), (4, "http://a.com/4", PAGE.format(main=main)[: PAGE.index("{main}") + 60]), (5, None, "<nav>cut off")]
    pages += [(10 + k, "http://b.com/x", PAGE.format(main=plain.format(k))) for k in range(4)]
    df = spark.createDataFrame([(i, u, h, 1) for i, u, h in pages], "page_id bigint, url string, html string, text int")
    got = {r.page_id: r for r in H.extract_main_text(df).collect()}
    assert got[1].text == "Title & more\none two three\nfouré" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[5].text == ""
    assert got[10].text == "Head 0\nBody 0 of some length"
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_pages_of_another_template_keep_their_text():
    usual = [PAGE.format(main=f"<article><h1>Head {k}</h1><p>Body {k} of some length</p></article>") for k in range(5)]
    whole = PAGE.format(main="<div><p>This page has no such element</p><p>but much to say</p></div>")
    open_end = whole.replace("</body></html>", "")  # end tags may be left out
    cut = usual[0][: usual[0].index("<article>")]
    got = H.extract_group([*usual, whole, open_end, cut])
    assert got[:5] == [f"Head {k}\nBody {k} of some length" for k in range(5)]
    assert got[5] == got[6] == "This page has no such element\nbut much to say"
    assert got[7] == ""


def site(n, inside, outside="", end="</body></html>"):
    """n pages of one template with texts of their own."""
    say = lambda k, m: " ".join(f"w{(k * 37 + j * j) % 997}" for j in range(m))
    return [f"<html><body><nav><a href=/>home</a></nav><article>{inside.format(k, say(k, 30 + k), say(k + 50, 40))}</article>{outside.format(k)}<footer>f</footer>{end}" for k in range(n)]


def test_classes_decide_what_is_template_text(monkeypatch):
    box = "<div class='x9'><p>Join our list</p><p>We write every week to you</p></div>"
    pages = site(6, "<h1>Title {0}</h1><p>{1}</p>" + box + "<p>{2}</p>")
    got = H.extract_group(pages)
    assert all("Join our list" not in t and "every week" not in t for t in got)
    assert [t.split("\n")[0] for t in got] == [f"Title {k}" for k in range(6)] and all(t.count("\n") == 2 for t in got)
    monkeypatch.setattr(H, "nest", lambda classes: [])  # without classes nothing is known to repeat
    assert all("Join our list" in t for t in H.extract_group(pages))


def test_a_box_on_most_pages_only_goes_too():
    box = "<div><p>Join our list</p><p>We write every week to you</p></div>"
    pages = site(4, "<h1>Title {0}</h1><p>{1}</p>" + box + "<p>{2}</p>") + site(9, "<h1>Title {0}</h1><p>{1}</p><p>{2}</p>")[4:7]
    assert not any("Join" in t for t in H.extract_group(pages))


def test_names_within_the_article_lose_no_prose():
    inside = "<div class='post-header'><h1>Title {0}</h1></div><section class='related work'><p>{1}</p></section><h2 id='search'>Search {0}</h2><p class='side'>{2}</p><label>Label {0}</label>"
    for k, t in enumerate(H.extract_group(site(5, inside))):
        assert t.split("\n")[0] == f"Title {k}" and f"Search {k}" in t and t.endswith(f"Label {k}") and t.count("\n") == 4
    inside = "<h1>Title {0}</h1><p>{1}</p><div class='ad-slot'>buy {0}</div><div class='related'><a href=/>other {0}</a></div><div id='comments'><p>I say {0} {1}</p></div><p>{2}</p>"
    for k, t in enumerate(H.extract_group(site(5, inside))):
        assert t.startswith(f"Title {k}\n") and t.count("\n") == 2 and not any(x in t for x in ("buy", "other", "I say"))


def test_the_article_is_found_without_names():
    pages = [p.replace("<article>", "<div class=q7><div class=q8>").replace("</article>", "</div></div>") for p in site(5, "<h1>Title {0}</h1><div class=z><p>{1}</p><p>{2}</p></div>", "<div>See also {0}</div>")]
    for k, t in enumerate(H.extract_group(pages)):
        assert t.startswith(f"Title {k}\n") and t.count("\n") == 2 and "See also" not in t


def test_form_around_the_whole_page_is_no_form():
    pages = [p.replace("<body>", "<body><form>").replace("</body>", "</form></body>") for p in site(5, "<h1>Title {0}</h1><p>{1}</p>")]
    assert all(t.startswith(f"Title {k}\n") for k, t in enumerate(H.extract_group(pages)))


def slow_classes(pages):
    """Vectors and orders by definition: every token's places, page by page."""
    sequences = []
    for page in pages:
        seq = []
        for kind, k in page.order:
            if kind == "b":
                w = page.said(k)
                w = ["^" + w[0], *w[1:]]
                w[-1] += "$"
                seq += [(page.paths[page.blocks[k][0][0]], x) for x in w]
            else:
                seq.append((kind, page.paths[k]))
        sequences.append(seq)
    groups = collections.defaultdict(list)
    for t in {t for s in sequences for t in s}:
        v = tuple(s.count(t) for s in sequences)
        if sum(n > 0 for n in v) >= max(H.MIN_PAGES, len(pages) / 2):
            groups[v].append(t)
    return {v: set(g) for v, g in groups.items() if len(g) >= H.MIN_TOKENS}, sequences


def test_classes_match_brute_force():
    pages = [H.Page(p) for p in site(7, "<h1>Title {0}</h1><p>{1}</p><ul><li><b>Price</b> on request<li><b>Price</b> on request</ul><p>{2} end of story {1}</p>", "<div>See also {0}</div>")]
    template, (expect, sequences) = H.Template(pages), slow_classes(pages)
    names = {k: (t[0], t[1:]) for t, k in template.tags.items()}
    found = {tuple(len(p) for p in places): members for members, places in template.vectors()}
    assert {v: len(m) for v, m in found.items()} == {v: len(m) for v, m in expect.items()}
    for v, members in found.items():
        assert {names[t] for t in members if t in names} == {t for t in expect[v] if t[0] in "</"}
    assert len(template.classes) >= 2
    for c in template.classes:  # each class is its tokens in order, over and over, in every page
        for seq, places in zip(template.sequences, c.places):
            mine = [t for t in seq.tolist() if t in set(c.tokens)]
            assert mine == c.tokens * len(places)
    for a in template.classes:  # and no two cross
        for b in template.classes:
            assert a is b or all(H.within_gaps(p, q) or H.within_gaps(q, p) for p, q in zip(a.places, b.places))


def test_tokens_out_of_order_are_taken_out():
    import numpy as np

    places = [np.array([[1, 2, 9, 4, 5]]), np.array([[1, 2, 3, 4, 5]]), np.array([[11, 12, 10, 14, 15]])]
    assert H.in_order([7, 8, 9, 10, 11], places).tokens == [7, 8, 10, 11]
    assert H.in_order([1, 2], [np.array([[1, 2]])]) is None


def test_groups_do_not_depend_on_partitions_and_odd_pages_work(spark):
    pages = site(70, "<h1>Title {0}</h1><p>{1}</p><div><p>Join our list today</p></div><p>{2}</p>")
    rows = [(k, f"http://a.com/{k}", h) for k, h in enumerate(pages)]
    rows += [(0, "http://a.com/0", pages[0]), (500, "http://b.com/1", pages[3]), (501, "http://B.com/2", "<p>" + "long " * 200_000), (None, None, pages[1]), (502, "http://a.com/x", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, n_chars int")
    a = sorted(map(str, H.extract_main_text(df).collect()))
    b = sorted(map(str, H.extract_main_text(df.repartition(13)).collect()))
    assert a == b and len(a) == len(rows)
    got = {r.page_id: r for r in H.extract_main_text(df).collect()}
    assert got[0].text.startswith("Title 0\n") and "Join" not in got[0].text and "Join" in got[500].text  # one page of a host has no template
    assert got[501].text == ("long " * 200_000).strip() and got[501].n_chars == 999_999 and got[502].text == ""
