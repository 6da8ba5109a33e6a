"""A Spark-native engine for sequence reads, taxonomies and taxon assignment."""
