"""Canonical lists and variant spellings."""

import pytest
from pyspark.sql import functions as F

from sonmai.llm import canonical, names, variants

TYPES = [(1, "Quyết định", "QĐ"), (2, "Thông báo", "TB"), (3, "Tờ trình", "TTr"), (4, "Thông tư", "TT"), (5, "Hướng dẫn", "HD"), (6, "Hợp đồng", "HĐ"), (7, "Đề án", "ĐA")]
AGENCIES = [(1, "Sở Y tế tỉnh Xuân Kiệu", "SYT Xuân Kiệu"), (2, "Sở Nội vụ tỉnh Xuân Kiệu", "SNV Xuân Kiệu"), (3, "Ủy ban nhân dân huyện Phù Điền", "UBND Phù Điền"), (4, "Công ty cổ phần Hạt Dẻ", "CTCP Hạt Dẻ"), (5, "Sở Tài nguyên và Môi trường tỉnh Phù Điền", "STNMT Phù Điền")]


@pytest.mark.parametrize("v, want", [("quyet dinh", 1), ("QYUẾT ĐỊNH", 1), ("(Thông báo)", 2), ("Thông báo số", 2), ("Văn bản tờ trình", 3), ("T. trình", 3), ("TTr.", 3), ("TT", 4), ("HD", 5), ("HĐ", 6), ("Hợpđồng", 6), ("dee an", 7), ("Tờ rơi", 0), ("N/A", 0), ("???", 0), ("x", 0)])
def test_types(v, want):
    assert canonical.Types(TYPES).find(v)[0] == want


@pytest.mark.parametrize(
    "v, want",
    [
        ("SYT-XUAN KIEU", 1), ("Sở Y tế (Xuân Kiệu)", 1), ("Xuân Kiệu - Sở Y tế tỉnh", 1), ("so noi vu tnih xuan kieu", 2), ("UBND huyện Phù Điền", 3), ("Ủy ban nhân dân H. Phù Điền", 3), ("Cty CP Hạt Dẻ", 4), ("Cong ty co phan Hat De", 4), ("Sở TN&MT tỉnh Phù Điền", 5),
        ("Sở Y tế tỉnh Phù Điền", 0), ("Tổ hội Nuôi ong Hang Dơi", 0), ("Phù Điền", 0),
    ],
)
def test_agencies(v, want):
    assert canonical.Agencies(AGENCIES).find(v)[0] == want


def test_distance_by_cases():
    assert names.distance("abcd", "abdc") == 1 and names.distance("việt", "viet") == pytest.approx(0.1) and names.distance("", "ab") == 2 and names.distance("a", "zzzzzz", 2) == 3


def test_map_rows(spark):
    t = spark.createDataFrame([(1, "Quyet dinh", "SYT Xuân Kiệu"), (2, "Quyết định", None), (3, " ", "Tổ hội"), (3, None, "Tổ hội")], "label_id long, a string, b string").withColumnRenamed("a", "kind").withColumnRenamed("b", "value")
    fields = {"k": ("kind", TYPES, "type"), "v": ("value", AGENCIES, "agency")}
    got = {(r.label_id, r.field, r.ref_id) for r in canonical.canonical_map(t, "label_id", fields).collect()}
    assert got == {(1, "k", 1), (2, "k", 1), (1, "v", 1), (3, "v", 0)}
    assert [(r.value, r.n) for r in canonical.misses(canonical.canonical_map(t, "label_id", fields)).collect()] == [("Tổ hội", 2)]
    assert {r.ref_id for r in canonical.canonical_map(t, "label_id", {"k": ("kind", [], "type")}).collect()} == {0}
    assert canonical.canonical_map(t.where("false"), "label_id", fields).count() == 0


def test_long_lists_are_cut_into_dictionaries(spark, monkeypatch):
    refs = AGENCIES + [(100 + i, f"Trạm Bơm số {i} huyện Gò {chr(97 + i % 26)}", None) for i in range(60)]
    values = [v for _, n, s in AGENCIES for v in (n, s, n.upper(), n[:-1])] + ["Tổ hội Nuôi ong", "Trạm Bơm số 7 huyện Gò h"]
    t = spark.createDataFrame([(v,) for v in values], "value string").distinct()
    whole = {r.value: r.ref_id for r in canonical.map_values(t, refs, "agency").collect()}
    monkeypatch.setattr(canonical, "PART", 10)
    cut = {r.value: (r.ref_id, r.exact) for r in canonical.map_values(t, refs, "agency").collect()}
    assert {v: i for v, (i, _) in cut.items()} == whole and cut["Sở Y tế tỉnh Xuân Kiệu"] == (1, True) and cut["Trạm Bơm số 7 huyện Gò h"] == (107, True) and cut["Tổ hội Nuôi ong"][0] == 0
    monkeypatch.setattr(canonical, "PART_BYTES", 20_000)
    assert len(canonical.dictionaries(refs, "agency", None)) > 7


PEOPLE = {
    "a": ["Trần Văn Xuân Tuất", "trần văn xuân tuất", "Tran Van Xuan Tuat", "Tuất, Trần Văn Xuân", "Tuất Trần Văn Xuân", "T.V.X. Tuất", "Tr. Văn Xuân Tuất", "TS. Trần Tuất", "Trần Văn Xuân “Bờm” Tuất", "Trần-Văn Xuân-Tuất", "Trần Văn Xuâ Tuất", "Trần V. X. Tuất"],
    "b": ["Trịnh Kim Hữu Tuất", "Trịnh K. H. Tuất", "T.K.H. Tuất"],
    "c": ["Trần Văn Xuân Đoan", "Đoan Trần Văn Xuân"],
    "d": ["Đoàn Gia Đoan", "Doan Gia Doan"],
}
BODIES = {
    "a": ["Sở Y tế tỉnh Xuân Kiệu", "SYT Xuân Kiệu", "Xuân Kiệu - Sở Y tế tỉnh", "so y te tinh xuan kieu", "SỞ Y TẾ TỈNH XUÂN KIỆU.", "Sở Y tế (Xuân Kiệu)", "Sở Y té tỉnh Xuân Kiệ"],
    "b": ["Sở Y tế tỉnh Phù Điền", "SYT-PHU DIEN"],
    "c": ["Sở Nội vụ tỉnh Xuân Kiệu", "SNV Xuân Kiệu"],
    "d": ["Sở Nội vụ tỉnh Phù Điền", "Sở Nội vụ tỉnh Bạch Đàm"][:1],
    "e": ["Văn phòng", "VĂN PHÒNG"],
}


def test_variants_linked(spark):
    rows = []
    for field, groups in (("p", PEOPLE), ("b", BODIES)):
        for g in groups.values():
            for i, v in enumerate(g):
                rows += [(field, v)] * (9 if i == 0 else 1)
    rows += [("b", "Sở Nội vụ tỉnh Bạch Đàm")] * 5 + [("b", "Sở Y tế tỉnh Bạch Đàm")] * 5 + [("p", None), ("p", "  "), ("p", "Ai")]
    t = spark.createDataFrame(rows, "f string, v string").selectExpr("CASE WHEN f = 'b' THEN v END AS body", "CASE WHEN f = 'p' THEN v END AS person", "'clash' AS value", "1 AS n", "'clash' AS entity")
    got = {(r.field, r.name_a, r.name_b) for r in variants.linked(variants.entities(t, {"b": "body"}, {"p": "person"})).collect()}
    want = {(f, a, b) for f, groups in (("p", PEOPLE), ("b", BODIES)) for g in groups.values() for a in g for b in g if a < b}
    assert got == want
    assert variants.linked(variants.entities(t.where("false"), {"b": "body"}, {"p": "person"})).count() == 0


def test_assignment():
    assert variants.assignment(["v", "xuân"], ["văn", "xuân"]) == pytest.approx(0.1)
    assert variants.assignment([], ["văn"]) < 0.1 < 1 < variants.assignment(["kim"], ["văn"])


def test_other_middle_names_are_other_persons(spark):
    rows = [("Nguyễn Văn Hùng", 50), ("Nguyễn Đức Hùng", 40), ("Nguyễn Vân Hùng", 2), ("Nguyễn V. Hùng", 3), ("Nguyễn Đ. Hùng", 3), ("Nguyen Duc Hung", 2), ("Trần Văn Nam", 30), ("Lê Thị Hà", 30), ("Trần Thị Hà", 20)]
    t = spark.createDataFrame([(v,) for v, n in rows for _ in range(n)], "person string").withColumn("body", F.lit(None).cast("string"))
    e = variants.entities(t, {"b": "body"}, {"p": "person"})
    got = {(r.name_a, r.name_b) for r in variants.linked(e).collect()}
    groups = [("Nguyễn Văn Hùng", "Nguyễn Vân Hùng", "Nguyễn V. Hùng"), ("Nguyễn Đức Hùng", "Nguyễn Đ. Hùng", "Nguyen Duc Hung")]
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}
    assert {(r.value, r.n_links) for r in variants.classes(e).collect()} == {(v, 2) for g in groups for v in g} | {(v, 0) for v, _ in rows[6:]}
