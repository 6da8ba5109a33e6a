"""Signature rules for license texts, each written by hand: label, keyword, confidence, pattern.

Patterns run over words in lower case, joined by one space.  The keyword is a word that every text
the pattern matches holds.  Sections are in order of priority.  ``{U}`` is the wording of a grant.
"""

U = "(?:licensed|released|distributed|available|provided|published|offered|redistributed|covered|used) under (?:the )?(?:terms of )?(?:the )?"

#: section whose patterns may follow a grant
GRANTED = 2

SECTIONS = (
    # 0: sentences of the licenses themselves
    """
mit | charge | 1 | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | sublicense | 1 | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | noninfringement | .6 | merchantability fitness for a particular purpose and noninfringement
mit | portions | .8 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
x11 | consortium | .9 | except as contained in this notice the name of the x consortium shall not be used
isc | fee | 1 | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution | 1 | redistribution and use in source and binary forms with or without modification are permitted
bsd | retain | .9 | redistributions of source code must retain the above copyright notice this list of conditions
bsd | reproduce | .9 | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse | 1 | (?:names?|contributors) may be used to endorse or promote products derived from this software
bsd-3-clause | endorse | .9 | may not be used to endorse or promote products derived from this software
bsd-4-clause | advertising | 1 | all advertising materials mentioning features or use of this software must display
bsd-2-clause | freebsd | .9 | representing official policies either expressed or implied of the freebsd project
apache-2 | compliance | 1 | you may not use this file except in compliance with the license
apache-2 | perpetual | .9 | hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1.1 | apache | 1 | this product includes software developed by the apache software foundation
gpl-1 | general | 1 | gnu general public license as published by the free software foundation either version 1 of the license
gpl-2-or-later | general | 1 | gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3-or-later | general | 1 | gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-2 | general | 1 | gnu general public license version 2 as published by the free software foundation
gpl-3 | general | 1 | gnu general public license version 3 as published by the free software foundation
gpl | redistribute | .95 | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | received | .7 | you should have received a copy of the gnu general public license along with this program
lgpl-2.1-or-later | lesser | 1 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
lgpl-3-or-later | lesser | 1 | gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
lgpl-2-or-later | library | 1 | gnu library general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
lgpl | redistribute | .95 | you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl | received | .7 | you should have received a copy of the gnu lesser general public license along with this library
agpl-3-or-later | affero | 1 | gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
agpl | redistribute | .95 | you can redistribute it and or modify it under the terms of the gnu affero general public license
gfdl | document | 1 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | invariant | .7 | with no invariant sections no front cover texts and no back cover texts
mpl-2 | form | 1 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | contents | 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | contents | 1 | the contents of this file are subject to the mozilla public license version 1 0
npl | netscape | 1 | the contents of this file are subject to the netscape public license
epl-1 | accompanying | 1 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2 | accompanying | 1 | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
cpl | accompanying | 1 | this program and the accompanying materials are made available under the terms of the common public license
cddl | contents | 1 | the contents of this file are subject to the terms of the common development and distribution license
unlicense | unencumbered | 1 | this is free and unencumbered software released into the public domain
unlicense | detriment | .9 | to the detriment of our heirs and successors
zlib | altered | 1 | altered source versions must be plainly marked as such
zlib | misrepresented | .9 | the origin of this software must not be misrepresented
zlib | warranty | .7 | this software is provided as is without any express or implied warranty
boost-1 | organization | 1 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
wtfpl | fuck | 1 | do what the fuck you want to public license
beerware | beer | 1 | you can buy me a beer in return
beerware | beerware | 1 | the beerware license
cc0 | waives | .95 | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
ofl-1.1 | reserved | 1 | no modified version of the font software may use the reserved font name
artistic-1 | intent | .8 | the intent of this document is to state the conditions under which a package may be copied
psf-2 | python | 1 | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly prepare derivative works distribute and otherwise use python
openssl | openssl | 1 | this product includes software developed by the openssl project
ncsa | illinois | .9 | neither the names of (?:the )?university of illinois
postgresql | documentation | .9 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
upl-1 | patent | .8 | the universal permissive license upl version 1 0 subject to the condition set forth below permission is hereby granted free of charge to any person obtaining a copy of this software associated documentation and or data and patent rights
ijg | jpeg | .9 | this software is based in part on the work of the independent jpeg group
w3c | w3c | .9 | this work is being provided by the copyright holders under the following license by obtaining and or copying this work w3c
json | evil | 1 | the software shall be used for good not evil
vim | vim | .9 | vim is charityware
sqlite-blessing | blessing | .9 | in place of a legal notice here is a blessing
commons-clause | sell | .9 | the license does not grant to you the right to sell the software
""",
    # 1: machine-readable identifiers and addresses of license texts
    """
mit | mit | 1 | spdx license identifier mit
mit-0 | mit | 1 | spdx license identifier mit 0
apache-2 | apache | 1 | spdx license identifier apache 2 0
apache-2-llvm | llvm | 1 | spdx license identifier apache 2 0 with llvm exception
apache-1.1 | apache | 1 | spdx license identifier apache 1 1
bsd-2-clause | bsd | 1 | spdx license identifier bsd 2 clause
bsd-3-clause | bsd | 1 | spdx license identifier bsd 3 clause
bsd-4-clause | bsd | 1 | spdx license identifier bsd 4 clause
0bsd | 0bsd | 1 | spdx license identifier 0bsd
isc | isc | 1 | spdx license identifier isc
gpl-1 | gpl | 1 | spdx license identifier gpl 1 0(?: only)?
gpl-2 | gpl | 1 | spdx license identifier gpl 2 0(?: only)?
gpl-2-or-later | gpl | 1 | spdx license identifier gpl 2 0 or later
gpl-3 | gpl | 1 | spdx license identifier gpl 3 0(?: only)?
gpl-3-or-later | gpl | 1 | spdx license identifier gpl 3 0 or later
gpl-2-classpath | classpath | 1 | spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
lgpl-2 | lgpl | 1 | spdx license identifier lgpl 2 0(?: only)?
lgpl-2.1 | lgpl | 1 | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | lgpl | 1 | spdx license identifier lgpl 2 1 or later
lgpl-3 | lgpl | 1 | spdx license identifier lgpl 3 0(?: only)?
lgpl-3-or-later | lgpl | 1 | spdx license identifier lgpl 3 0 or later
agpl-3 | agpl | 1 | spdx license identifier agpl 3 0(?: only)?
agpl-3-or-later | agpl | 1 | spdx license identifier agpl 3 0 or later
gfdl | gfdl | 1 | spdx license identifier gfdl 1 [1-3](?: only| or later)?
mpl-1.1 | mpl | 1 | spdx license identifier mpl 1 1
mpl-2 | mpl | 1 | spdx license identifier mpl 2 0
epl-1 | epl | 1 | spdx license identifier epl 1 0
epl-2 | epl | 1 | spdx license identifier epl 2 0
cddl | cddl | 1 | spdx license identifier cddl 1 [01]
eupl | eupl | 1 | spdx license identifier eupl 1 [0-2]
artistic-1 | artistic | 1 | spdx license identifier artistic 1 0
artistic-2 | artistic | 1 | spdx license identifier artistic 2 0
zlib | zlib | 1 | spdx license identifier zlib
boost-1 | bsl | 1 | spdx license identifier bsl 1 0
bsl-1.1 | busl | 1 | spdx license identifier busl 1 1
unlicense | unlicense | 1 | spdx license identifier unlicense
wtfpl | wtfpl | 1 | spdx license identifier wtfpl
cc0 | cc0 | 1 | spdx license identifier cc0 1 0
cc-by | by | 1 | spdx license identifier cc by [1-4] [05]
cc-by-sa | sa | 1 | spdx license identifier cc by sa [1-4] [05]
cc-by-nc | nc | 1 | spdx license identifier cc by nc [1-4] [05]
cc-by-nd | nd | 1 | spdx license identifier cc by nd [1-4] [05]
cc-by-nc-sa | nc | 1 | spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd | nc | 1 | spdx license identifier cc by nc nd [1-4] [05]
ofl-1.1 | ofl | 1 | spdx license identifier ofl 1 1
postgresql | postgresql | 1 | spdx license identifier postgresql
ncsa | ncsa | 1 | spdx license identifier ncsa
upl-1 | upl | 1 | spdx license identifier upl 1 0
ms-pl | ms | 1 | spdx license identifier ms pl
sspl-1 | sspl | 1 | spdx license identifier sspl 1 0
elastic-2 | elastic | 1 | spdx license identifier elastic 2 0
proprietary | licenseref | .8 | spdx license identifier licenseref (?:proprietary|commercial)
apache-2 | apache | 1 | apache org licenses license 2 0
mit | opensource | 1 | opensource org licenses? mit(?: license)?
bsd-2-clause | opensource | 1 | opensource org licenses? bsd 2 clause
bsd-3-clause | opensource | 1 | opensource org licenses? bsd 3 clause
isc | opensource | 1 | opensource org licenses? isc
gpl-2 | gnu | .95 | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3 | gnu | .95 | gnu org licenses gpl 3 0
gpl | gnu | .8 | gnu org licenses gpl
lgpl | gnu | .9 | gnu org licenses lgpl
agpl | gnu | .9 | gnu org licenses agpl
gfdl | gnu | .9 | gnu org licenses fdl
mpl-2 | mozilla | 1 | mozilla org mpl 2 0
mpl | mozilla | .8 | mozilla org mpl
epl-1 | eclipse | 1 | eclipse org legal epl v10
epl-2 | eclipse | 1 | eclipse org legal epl (?:2 0|v20)
boost-1 | boost | 1 | boost org license 1 0
unlicense | unlicense | 1 | unlicense org
wtfpl | wtfpl | 1 | wtfpl net
cc0 | creativecommons | 1 | creativecommons org publicdomain zero
public-domain | creativecommons | 1 | creativecommons org publicdomain mark
cc-by | creativecommons | 1 | creativecommons org licenses by
cc-by-sa | creativecommons | 1 | creativecommons org licenses by sa
cc-by-nc | creativecommons | 1 | creativecommons org licenses by nc
cc-by-nd | creativecommons | 1 | creativecommons org licenses by nd
cc-by-nc-sa | creativecommons | 1 | creativecommons org licenses by nc sa
cc-by-nc-nd | creativecommons | 1 | creativecommons org licenses by nc nd
ofl-1.1 | scripts | 1 | scripts sil org ofl
odbl-1 | opendatacommons | 1 | opendatacommons org licenses odbl
odc-by | opendatacommons | 1 | opendatacommons org licenses by
pddl-1 | opendatacommons | 1 | opendatacommons org licenses pddl
sspl-1 | mongodb | 1 | mongodb com licensing server side public license
""",
    # 2: names with their version; a grant may stand before them
    """
apache-2 | apache | .95 | apache license(?: version)? (?:v )?2(?: 0)?
apache-2 | apache | .95 | apache software license(?: version)? 2(?: 0)?
apache-2 | apache | .9 | apache 2(?: 0)? licen[sc]ed?
apache-2 | asl | .8 | asl 2 0
apache-1.1 | apache | .95 | apache(?: software)? license(?: version)? 1 1
apache-1.0 | apache | .95 | apache(?: software)? license(?: version)? 1 0
bsd-2-clause | bsd | .95 | (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[sc]e
bsd-2-clause | freebsd | .9 | freebsd (?:copyright|licen[sc]e)
bsd-3-clause | bsd | .95 | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[sc]e
bsd-4-clause | bsd | .95 | (?:original bsd|old bsd|bsd 4 clause|4 clause bsd) licen[sc]e
0bsd | 0bsd | .9 | 0bsd licen[sc]e
bsd-2-patent | patent | .95 | bsd 2 clause plus patent licen[sc]e
gpl-1 | general | .95 | gnu general public licen[sc]e(?: gpl)?(?: version)? (?:v ?)?1
gpl-2 | general | .95 | gnu general public licen[sc]e(?: gpl)?(?: version)? (?:v ?)?2
gpl-2 | general | .95 | gnu general public licen[sc]e(?: gpl)? v2
gpl-2-or-later | general | .95 | gnu general public licen[sc]e(?: gpl)? (?:version 2|v2)(?: 0)? or (?:any )?later
gpl-3 | general | .95 | gnu general public licen[sc]e(?: gpl)?(?: version)? (?:v ?)?3
gpl-3 | general | .95 | gnu general public licen[sc]e(?: gpl)? v3
gpl-3-or-later | general | .95 | gnu general public licen[sc]e(?: gpl)? (?:version 3|v3)(?: 0)? or (?:any )?later
gpl-2 | gpl | .9 | gpl (?:version 2|v2|v 2|2 0)(?: only)?
gpl-2-or-later | gpl | .9 | gpl (?:version 2|v2|2 0) or (?:any )?later
gpl-3 | gpl | .9 | gpl (?:version 3|v3|v 3|3 0)(?: only)?
gpl-3-or-later | gpl | .9 | gpl (?:version 3|v3|3 0) or (?:any )?later
gpl-2 | gplv2 | .9 | gplv2
gpl-3 | gplv3 | .9 | gplv3
lgpl-2 | library | .95 | gnu library general public licen[sc]e(?: version)? (?:v ?)?2(?: 0)?
lgpl-2.1 | lesser | .95 | gnu lesser general public licen[sc]e(?: lgpl)?(?: version)? (?:v ?)?2 1
lgpl-3 | lesser | .95 | gnu lesser general public licen[sc]e(?: lgpl)?(?: version)? (?:v ?)?3
lgpl-2.1 | lgpl | .9 | lgpl (?:version 2 1|v2 1|v 2 1|2 1)(?: only| or later)?
lgpl-3 | lgpl | .9 | lgpl (?:version 3|v3|v 3|3 0)(?: only| or later)?
lgpl-2.1 | lgplv2 | .9 | lgplv2(?: 1)?
lgpl-3 | lgplv3 | .9 | lgplv3
agpl-3 | affero | .95 | (?:gnu )?affero general public licen[sc]e(?: agpl)?(?: version)? (?:v ?)?3
agpl-3 | agpl | .9 | agpl (?:version 3|v3|v 3|3 0)(?: only| or later)?
agpl-3 | agplv3 | .9 | agplv3
gfdl-1.2 | documentation | .95 | gnu free documentation licen[sc]e(?: version)? 1 2
gfdl-1.3 | documentation | .95 | gnu free documentation licen[sc]e(?: version)? 1 3
mpl-1.0 | mozilla | .95 | mozilla public licen[sc]e(?: mpl)?(?: version)?(?: v)? 1 0
mpl-1.1 | mozilla | .95 | mozilla public licen[sc]e(?: mpl)?(?: version)?(?: v)? 1 1
mpl-2 | mozilla | .95 | mozilla public licen[sc]e(?: mpl)?(?: version)?(?: v)? 2(?: 0)?
mpl-2 | mpl | .85 | mpl (?:version 2|v2|2 0)
mpl-1.1 | mpl | .85 | mpl (?:version 1 1|v1 1|1 1)
epl-1 | eclipse | .95 | eclipse public licen[sc]e(?: version)? (?:v ?)?1(?: 0)?
epl-1 | eclipse | .95 | eclipse public licen[sc]e v10
epl-2 | eclipse | .95 | eclipse public licen[sc]e(?: version)? (?:v ?)?2(?: 0)?
edl-1 | eclipse | .95 | eclipse distribution licen[sc]e(?: version)? (?:v ?)?1(?: 0)?
cpl-1 | common | .95 | common public licen[sc]e(?: version)? (?:v ?)?1(?: 0)?
cddl-1.0 | distribution | .95 | common development and distribution licen[sc]e(?: cddl)?(?: version)? (?:v ?)?1 0
cddl-1.1 | distribution | .95 | common development and distribution licen[sc]e(?: cddl)?(?: version)? (?:v ?)?1 1
cddl-1.0 | cddl | .85 | cddl (?:version 1 0|v1 0|1 0)
cddl-1.1 | cddl | .85 | cddl (?:version 1 1|v1 1|1 1)
artistic-1 | artistic | .95 | artistic licen[sc]e(?: version)? (?:v ?)?1(?: 0)?
artistic-2 | artistic | .95 | artistic licen[sc]e(?: version)? (?:v ?)?2(?: 0)?
boost-1 | boost | .95 | boost software licen[sc]e(?: version)? (?:v ?)?1 0
eupl-1.1 | european | .95 | european union public licen[sc]e(?: eupl)?(?: version)? (?:v ?)?1 1
eupl-1.2 | european | .95 | european union public licen[sc]e(?: eupl)?(?: version)? (?:v ?)?1 2
eupl-1.2 | eupl | .85 | eupl (?:version 1 2|v1 2|1 2)
ofl-1.1 | font | .95 | sil open font licen[sc]e(?: version)? (?:v ?)?1 1
ofl-1.0 | font | .95 | sil open font licen[sc]e(?: version)? (?:v ?)?1 0
php-3 | php | .95 | php licen[sc]e(?: version)? (?:v ?)?3(?: 0)?
php-3.01 | php | .95 | php licen[sc]e(?: version)? (?:v ?)?3 01
psf-2 | python | .95 | python software foundation licen[sc]e(?: version)? (?:v ?)?2
zpl-2.1 | zope | .95 | zope public licen[sc]e(?: zpl)?(?: version)? (?:v ?)?2 [01]
osl-3 | open | .9 | open software licen[sc]e(?: version)? (?:v ?)?3 0
afl-3 | academic | .95 | academic free licen[sc]e(?: version)? (?:v ?)?3 0
afl-2.1 | academic | .95 | academic free licen[sc]e(?: version)? (?:v ?)?2 1
ecl-2 | educational | .95 | educational community licen[sc]e(?: version)? (?:v ?)?2 0
nasa-1.3 | nasa | .95 | nasa open source agreement(?: version)? (?:v ?)?1 3
cecill-2.1 | cecill | .95 | cecill (?:free software )?(?:license )?(?:agreement )?(?:version |v )?2 1
cecill-b | cecill | .95 | cecill b
cecill-c | cecill | .95 | cecill c
lppl-1.3 | latex | .95 | latex project public licen[sc]e(?: version)? (?:v ?)?1 3
bsl-1.1 | business | .95 | business source licen[sc]e(?: version)? (?:v ?)?1 1
sspl-1 | server | .95 | server side public licen[sc]e(?: sspl)?(?: version)? (?:v ?)?1
elastic-2 | elastic | .95 | elastic licen[sc]e(?: version)? (?:v ?)?2(?: 0)?
cc-by | attribution | .95 | creative commons attribution [1-4] [05]
cc-by-sa | attribution | .95 | creative commons attribution share ?alike [1-4] [05]
cc-by-nc | attribution | .95 | creative commons attribution non ?commercial [1-4] [05]
cc-by-nd | attribution | .95 | creative commons attribution no ?deriv(?:ative)?s(?: works)? [1-4] [05]
cc-by-nc-sa | attribution | .95 | creative commons attribution non ?commercial share ?alike [1-4] [05]
cc-by-nc-nd | attribution | .95 | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? [1-4] [05]
cc0 | cc0 | .95 | cc0 1 0
cc-by | by | .9 | cc by [1-4] [05]
cc-by-sa | sa | .9 | cc by sa [1-4] [05]
cc-by-nc | nc | .9 | cc by nc [1-4] [05]
cc-by-nd | nd | .9 | cc by nd [1-4] [05]
cc-by-nc-sa | nc | .9 | cc by nc sa [1-4] [05]
cc-by-nc-nd | nc | .9 | cc by nc nd [1-4] [05]
odbl-1 | database | .95 | open database licen[sc]e(?: odbl)?(?: version)? (?:v ?)?1 0
""",
    # 3: grants that name a license without version, exceptions, dual licenses
    """
mit | mit | .95 | {U}mit(?: open source)?(?: licen[sc]e)?
mit | expat | .95 | {U}expat licen[sc]e
mit | mit | .85 | mit licen[sc]ed?
mit | mit | .9 | mit style licen[sc]e
mit-0 | attribution | .95 | mit no attribution(?: licen[sc]e)?
apache | apache | .9 | {U}apache(?: software)? licen[sc]e
bsd | bsd | .9 | {U}bsd(?: style)? licen[sc]e
bsd | bsd | .8 | bsd(?: style| type)? licen[sc]ed?
bsd | berkeley | .9 | berkeley software distribution licen[sc]e
isc | isc | .9 | {U}isc licen[sc]e
isc | isc | .8 | isc licen[sc]e
gpl | general | .9 | {U}gnu general public licen[sc]e
gpl | general | .8 | gnu general public licen[sc]e
gpl | gpl | .9 | {U}(?:gnu )?gpl
gpl | gpl | .8 | (?:gnu gpl|gpl licen[sc]ed?)
gpl-classpath | classpath | .95 | gpl (?:version 2 )?with (?:the )?classpath exception
gpl-linking | linking | .9 | as a special exception the copyright holders of this library give you permission to link(?:ing)? this library with independent modules linking
gpl-font | font | .9 | gpl with (?:the )?font exception
gpl-autoconf | autoconf | .9 | as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf
lgpl | lesser | .9 | {U}gnu lesser general public licen[sc]e
lgpl | lesser | .8 | gnu lesser general public licen[sc]e
lgpl | library | .8 | gnu library general public licen[sc]e
lgpl | lgpl | .9 | {U}(?:gnu )?lgpl
lgpl | lgpl | .8 | (?:gnu lgpl|lgpl licen[sc]ed?)
agpl | affero | .9 | (?:gnu )?affero general public licen[sc]e
agpl | agpl | .9 | {U}(?:gnu )?agpl
agpl | agpl | .8 | (?:gnu agpl|agpl licen[sc]ed?)
gfdl | documentation | .9 | gnu free documentation licen[sc]e
gfdl | gfdl | .8 | {U}(?:gnu )?gfdl
mpl | mozilla | .9 | mozilla public licen[sc]e
mpl | mpl | .85 | {U}mpl
epl | eclipse | .9 | eclipse public licen[sc]e
edl | eclipse | .9 | eclipse distribution licen[sc]e
cpl | common | .9 | common public licen[sc]e
ibm-pl | ibm | .9 | ibm public licen[sc]e
cddl | distribution | .9 | common development and distribution licen[sc]e
cddl | cddl | .85 | {U}cddl
artistic | artistic | .9 | {U}artistic licen[sc]e
artistic | perl | .9 | under the same terms as perl(?: itself)?
zlib | zlib | .9 | {U}zlib(?: libpng)? licen[sc]e
zlib | zlib | .8 | zlib(?: libpng)? licen[sc]e
libpng | libpng | .9 | {U}libpng licen[sc]e
boost-1 | boost | .9 | boost software licen[sc]e
boost-1 | boost | .9 | {U}boost licen[sc]e
unlicense | unlicense | .9 | {U}unlicense
wtfpl | wtfpl | .9 | {U}wtfpl
beerware | beerware | .9 | {U}beerware licen[sc]e
eupl | european | .9 | european union public licen[sc]e
ofl | font | .9 | (?:sil )?open font licen[sc]e
ofl | ofl | .85 | {U}(?:sil )?ofl
psf | python | .9 | python software foundation licen[sc]e
psf | psf | .9 | {U}psf(?: licen[sc]e)?
php | php | .9 | {U}php licen[sc]e
ruby | ruby | .9 | {U}ruby(?: s)? licen[sc]e
openssl | openssl | .9 | {U}openssl licen[sc]e
postgresql | postgresql | .9 | {U}postgresql licen[sc]e
ncsa | ncsa | .9 | (?:university of illinois )?ncsa open source licen[sc]e
w3c | w3c | .9 | w3c software (?:notice and )?licen[sc]e
x11 | x11 | .9 | {U}x11 licen[sc]e
curl | curl | .9 | {U}curl licen[sc]e
vim | vim | .9 | {U}vim licen[sc]e
imagemagick | imagemagick | .9 | {U}imagemagick licen[sc]e
intel | intel | .9 | intel open source licen[sc]e
sun-sissl | sun | .9 | sun industry standards source licen[sc]e
apple-psl | apple | .9 | apple public source licen[sc]e
nasa | nasa | .9 | nasa open source agreement
ms-pl | microsoft | .9 | microsoft public licen[sc]e
ms-rl | microsoft | .9 | microsoft reciprocal licen[sc]e
ms-eula | microsoft | .9 | microsoft software licen[sc]e terms
upl-1 | universal | .9 | universal permissive licen[sc]e
ecl | educational | .9 | educational community licen[sc]e
osl | open | .7 | {U}open software licen[sc]e
afl | academic | .9 | academic free licen[sc]e
zpl | zope | .9 | zope public licen[sc]e
qpl | q | .9 | {U}q public licen[sc]e
lppl | latex | .9 | latex project public licen[sc]e
cecill | cecill | .9 | {U}cecill(?: licen[sc]e)?
bsl | business | .9 | business source licen[sc]e
sspl | server | .9 | server side public licen[sc]e
elastic | elastic | .9 | {U}elastic licen[sc]e
confluent | confluent | .9 | confluent community licen[sc]e
polyform-nc | polyform | .9 | polyform noncommercial licen[sc]e
polyform-sb | polyform | .9 | polyform small business licen[sc]e
commons-clause | clause | .9 | commons clause licen[sc]e condition
cc-by | attribution | .9 | creative commons attribution
cc-by-sa | attribution | .9 | creative commons attribution share ?alike
cc-by-nc | attribution | .9 | creative commons attribution non ?commercial
cc-by-nd | attribution | .9 | creative commons attribution no ?deriv(?:ative)?s(?: works)?
cc-by-nc-sa | attribution | .9 | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | attribution | .9 | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?
cc0 | zero | .9 | creative commons zero
cc0 | cc0 | .9 | {U}cc0
cc0 | universal | .95 | cc0 1 0 universal
cc-by | by | .8 | {U}cc by
cc-by-sa | sa | .8 | cc by sa
cc-by-nc | nc | .8 | cc by nc
cc-by-nd | nd | .8 | cc by nd
cc-by-nc-sa | nc | .85 | cc by nc sa
cc-by-nc-nd | nc | .85 | cc by nc nd
odbl | database | .9 | open database licen[sc]e
odbl | odbl | .85 | {U}odbl
pddl | pddl | .85 | {U}pddl
odc-by | attribution | .9 | open data commons attribution licen[sc]e
ogl-uk | government | .9 | open government licen[sc]e
cdla-permissive | community | .9 | community data license agreement permissive
cdla-sharing | community | .9 | community data license agreement sharing
openrail | rail | .9 | (?:open rail|responsible ai licen[sc]e rail)
openrail | openrail | .9 | openrail(?: m)?
llama | llama | .9 | llama (?:2 |3 )?community licen[sc]e
dual | dual | .7 | dual licensed under
""",
    # 4: the public domain, and what is not free
    """
public-domain | domain | .9 | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | domain | .8 | this (?:work|file|software|document|text) is in the public domain
public-domain | domain | .8 | no copyright (?:is )?claimed public domain
public-domain | government | .8 | work of the united states government
proprietary | reserved | .5 | all rights reserved
proprietary | proprietary | .8 | proprietary and confidential
proprietary | unauthorized | .7 | unauthorized (?:copying|use|distribution|reproduction)(?: of this file)?
proprietary | trade | .7 | trade secrets? of
proprietary | reproduced | .7 | no part of this (?:publication|book|work|document) may be reproduced
proprietary | written | .6 | without the (?:prior|express) written (?:permission|consent) of
proprietary | agreement | .7 | end user licen[sc]e agreement
proprietary | evaluation | .7 | for evaluation purposes only
noncommercial | commercial | .7 | for non commercial (?:use|purposes) only
noncommercial | personal | .6 | for personal use only
noncommercial | research | .7 | for (?:academic )?research (?:use|purposes) only
shareware | shareware | .7 | this (?:is|program is|software is) shareware
freeware | freeware | .7 | this (?:is|program is|software is) freeware
copyright | copyright | .3 | copyright (?:c )?(?:19|20)[0-9][0-9]
""",
)
