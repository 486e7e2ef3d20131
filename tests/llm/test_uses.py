"""Entries of equal cost: the one in use wins."""

from sonmai.llm import canonical

TYPES = [(1, "Tờ khai bac", None), (2, "Tờ khai bat", None)]
AGENCIES = [(1, "Sở Tư pháp Hà Bac", None), (2, "Sở Tư pháp Hà Bat", None)]


def test_ties_go_to_the_entry_in_use(labels):
    from pyspark.sql import functions as F

    for kind, refs, value in (("type", TYPES, "Tờ khai bax"), ("agency", AGENCIES, "Sở Tư pháp Hà Bax")):
        for wanted in (1, 2):
            rows = [(i, refs[wanted - 1][1]) for i in range(2, 7)] + [(1, value)]
            t = labels(rows).withColumn("kind", F.col("full_text"))
            got = {r.label_id: r.ref_id for r in canonical.canonical_map(t, "label_id", {"k": ("kind", refs, kind)}).collect()}
            assert got[1] == wanted and got[2] == wanted
