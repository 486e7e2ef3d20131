"""Chunks, scan repair, confusables, encoding and abusive content."""

import random
import re

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonmai.llm import abuse, bpe, chunking, confusables, ocr_repair


# --- chunks ---------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", "\n", ". ", " ", "  ", "x" * 50, "y" * 75, "ệ"]), max_size=150).map("".join))
def test_pieces_cover_and_break_well(text):
    at = 0
    got = chunking.cut(text, 60, 30, 8)
    for b, e, _ in got:
        assert e - b <= 60 and b <= at and (e > at or not text)
        at = e
    assert at == len(text)
    assert any(f for *_, f in got) == (max(map(len, re.split(r"\s", text)), default=0) > 60)


def test_edits_alter_neighbouring_pieces_only():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + rng.choice(["", ".", ",", "\n"]) for _ in range(6000))
    new = text[:9000] + " một câu mới được chèn vào đây " + text[9000:]
    d = len(new) - len(text)
    a, b = {e for _, e, _ in chunking.cut(text)}, {e - d for _, e, _ in chunking.cut(new)}
    assert len({e for e in a if e > 14000} & b) >= 0.9 * len({e for e in a if e > 14000})


def test_oversized(labels):
    rows = [(1, "x " * 1000), (2, "x " * 1001), (3, "y" * 2001), (4, "z" * 2000 + " ab"), (5, None), (6, ""), (7, ("từ " * 700 + "\n") * 50)]
    assert {(r.label_id, r.forced) for r in chunking.oversized(labels(rows), "label_id", "full_text").collect()} == {(2, 0), (3, 1), (4, 0), (7, 0)}
    p = chunking.pieces(labels(rows), "label_id", "full_text").collect()
    assert {r.label_id for r in p} == {1, 2, 3, 4, 6, 7} and [r.text for r in p if r.label_id == 6] == [""]
    assert chunking.pieces(labels([]), "label_id", "full_text").count() == 0
    with pytest.raises(ValueError):
        chunking.pieces(labels([]), "label_id", "full_text", 100, 200)


# --- confusables ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "given_, want",
    [
        ("ｈướｎｇ d﻿ẫn", "hướng dẫn"), ("ệ", "ệ"), ("só̂", "số"), ("kiếm", "kiếm"), ("Ðông Ɖà", "Đông Đà"), ("сần", "cần"), ("“Журнал”", "“Журнал”"), ("β Δ Ω", "β Δ Ω"), ("a b　c", "a b c"), ("𝟐𝟎", "20"),
        ("n\u200bă\u00adm", "năm"), ("– — ’", "– — ’"), ("хе", "xe"), ("a\nb\r\n", "a\nb\r\n"), ("m² ½ …", "m² ½ …"), ("", ""), (None, None), ("sο̂́", "số"), ("nu\u200b\u031bớc".replace("ớ", "\u01a1\u0301"), "nước"),
    ],
)
def test_consistent(given_, want):
    got = confusables.consistent(given_)
    assert got == want and confusables.consistent(got) == got


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aеоộ сụĐ̣́̂​ ｄ𝟐Ж\n"), max_size=20))
def test_consistent_is_stable(s):
    c = confusables.consistent(s)
    assert confusables.consistent(c) == c


def test_inconsistent_values(labels):
    t = labels([(1, "bình thường"), (2, "сần"), (3, None), (4, ""), (4, "a​" * 50_000)])
    assert sorted((r.label_id, r.field) for r in confusables.inconsistent_values(t, "label_id", {"full_text": "full_text"}).collect()) == [(2, "full_text"), (4, "full_text")]
    g = confusables.skeleton_groups(t.unionByName(labels([(9, "cần")])), "full_text").collect()
    assert max(r.n_spellings for r in g) == 2
    assert confusables.inconsistent_values(labels([]), "label_id", {"full_text": "full_text"}).count() == 0
    w = confusables.with_consistent(t, {"c": "full_text"}).where("label_id = 2").collect()[0]
    assert (w.c, w.id) == ("cần", "clash")


def test_odd_flags_agree_with_the_pattern():
    import pyarrow as pa

    s = ["abc", "–”ạ", "‏", "​", "ab ", "Ω", None, "", "𝟎", "　", "⁠x", "đĐ", "ð"]
    assert confusables.odd_flags(pa.array(s).slice(1)) == [bool(x and confusables._ODD.search(x)) for x in s[1:]]


# --- scan repair ------------------------------------------------------------------------------------------------------

SENTENCES = ["Ban {} quản lý {} chợ tiếp nhận {} hồ sơ của các hộ kinh doanh trong tháng này", "Phòng {} kế hoạch {} điều chỉnh {} dự toán xây dựng theo quyết định của ủy ban", "Các {} đơn vị {} chủ động kiểm tra {} thiết bị phòng cháy tại hiện trường"]


def page(rng, damage):
    words = " ".join(rng.choice(SENTENCES).format(*[rng.randint(100, 9999) for _ in range(3)]) + "." for _ in range(14)).split()
    head = ["SỞ NỘI VỤ TỈNH A", "Số: 12/QĐ", "Ngày 1 tháng 2 năm 2020"]
    if "chars" in damage:
        for i in rng.sample(range(5, len(words) - 5), 6):
            words[i] = words[i].replace("h", "li", 1).replace("n", "ri", 1) if "h" in words[i] or "n" in words[i] else words[i].replace("i", "1")
    lines, line = [], ""
    for w in words:
        if len(line) + len(w) + 1 > 50:
            if "hyphen" in damage and len(w) > 4 and len(line) + 3 < 50:
                line, w = f"{line} {w[:2]}-", w[2:]
                damage.add("cut")
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    lines.append(line)
    out = head
    for i, x in enumerate(lines):
        out = [*out, x]
        if i % 7 == 6:
            out += ["Bản sao số 7"] * ("header" in damage) + [f"- {i // 7 + 1} -"] * ("pageno" in damage)
    return "\n".join([*out, "Nguyễn Văn A"])


def test_damage_found_and_repaired(labels):
    rng = random.Random(3)
    rows, want = [], set()
    kinds = ("hyphen", "chars", "header", "pageno")
    for i in range(1, 81):
        damage = {k for j, k in enumerate(kinds) if i <= 32 and i >> j & 1}
        rows.append((i, page(rng, damage)))
        want |= {(i, k) for k in damage - {"cut", "hyphen"} | ({"hyphen"} if "cut" in damage else set())}
    rows += [(100, None), (101, ""), (102, "một dòng"), (103, "x" * 300_000)]
    t = labels(rows)
    got = {(r.label_id, r.kind) for r in ocr_repair.damage_found(t, "label_id", "full_text").collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 2
    fixed = {r.label_id: r.repaired for r in ocr_repair.repair_texts(t, "label_id", "full_text").collect()}
    assert fixed[100] is None and fixed[101] == "" and len(fixed[103]) == 300_000
    body = fixed[7].split("\n")
    assert not any(x.startswith("- ") or x.startswith("Bản sao") for x in body) and max(map(len, body)) > 200
    assert ocr_repair.damage_found(labels([]), "label_id", "full_text").count() == 0


# --- encoding ---------------------------------------------------------------------------------------------------------


def test_encoding_equals_the_library_and_decodes(spark):
    ranks = bpe.read_ranks()
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = [None, "", " ", "\n", "a" * 700 + " <|endoftext|> x²½Ⅳ  y\t\tz\x1c \n\n q ", "xin  chào bạn\r\n\r\n é  ", "I'll don't 'S _a_b __ 123abc٣٤ 日本語 🎉🎉", "\x85a b  c", "chợ́ ê"]
    texts += ["".join(rng.choice("aăâ đ\n\t .,-'1²日́🎉'") for _ in range(60)) for _ in range(150)]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("k", F.lit(1))
    t = t.unionByName(t.where("doc_id = 4"))
    enc = bpe.encode(t)
    got = enc.collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert list(r.ids) == lib.encode_ordinary(texts[r.doc_id] or "")
    assert all(r.decoded == (texts[r.doc_id] or "") for r in bpe.decode(enc).collect())
    assert bpe.encode(t.where("false")).count() == 0
    assert [list(r.ids) for r in bpe.encode(t.where("text IS NULL OR text = ''")).collect()] == [[], []]


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_heap_and_cut_equal_the_library(s):
    ranks = bpe.read_ranks() if not hasattr(test_heap_and_cut_equal_the_library, "r") else test_heap_and_cut_equal_the_library.r
    test_heap_and_cut_equal_the_library.r = ranks
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = [i for p in (bpe.pieces(s) if s else []) for w in bpe.words_of(p) for i in bpe.heap_merges(w.encode(), ranks)]
    assert got == lib.encode_ordinary(s)


# --- abusive content ---------------------------------------------------------------------------------------------------


def test_segments_by_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(rng.randint(1, 12))]
        best = max(0.0, *[sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)])
        import numpy as np

        assert abuse.best_segments(np.array(s), np.array([0, len(s)]))[0] == pytest.approx(best)
        assert max([x[2] for x in abuse.all_segments(s)], default=0.0) == pytest.approx(best)


def test_words_as_they_read():
    assert abuse.words_of("T.h.ằ.n.g") == ["thang"] and abuse.words_of("Qv@n") == ["quan"] and abuse.words_of("câuuuu") == ["cau"] and abuse.words_of("12/3") == ["#", "#"]


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    calm = ["phòng kế hoạch trả lời về dự toán", "nhà văn hóa hỏng đã lâu", "cán bộ hướng dẫn rất kỹ cảm ơn", "triển lãm tranh khỏa thân của câu lạc bộ"]
    bad = {"abuse": ["đồ ngu dốt cút đi cho khuất mắt", "mày là quân vô lại đáng ăn đòn"], "sexual": ["em cởi hết ra cho anh xem khỏa thân", "nhận khoe hàng trần truồng giá rẻ"]}
    rows, labels, truth = [], [], set()
    for i in range(600):
        s = [rng.choice(calm) + " " + str(rng.randint(1, 99)) for _ in range(6)]
        c = ("abuse", "sexual", None, None, None, None)[i % 6]
        if c:
            x = rng.choice(bad[c])
            s.insert(rng.randint(0, 6), x if i % 4 else " ".join(".".join(w) for w in x.split()))
            truth.add((i, c))
        rows.append((i, ". ".join(s), "nguồn"))
        if i < 300:
            labels += [(i, c or "none", "r")] * 2
    rows += [(900, None, "nguồn"), (901, "", None), (902, " ", "nguồn"), (903, "mày " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("flags", F.lit("clash")).withColumn("category", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, category string, reviewer string")
    got = {(r.doc_id, r.category) for r in abuse.found(docs, lab).collect() if r.doc_id < 900}
    held = {x for x in truth if x[0] >= 300}
    assert len(got & held) >= 0.95 * len(held) and len({x for x in got - truth if x[0] >= 300}) <= 3
    r = abuse.rates(docs, lab)
    assert r.agg(F.sum("n_docs")).collect()[0][0] == 604
    assert abuse.found(docs, lab.where("false")).count() == 0 and abuse.found(docs.where("false"), lab).count() == 0


def test_small_and_mixed_pages_are_repaired_alike_in_any_split(spark, labels):
    rng = random.Random(12)
    words = " ".join(rng.choice(SENTENCES).format(*[rng.randint(100, 9999) for _ in range(3)]) + "." for _ in range(3)).split()
    small = "\n".join(["SỞ NỘI VỤ TỈNH A", "Ban đại diện quản lý chợ tiếp nhận nhiều hồ sơ của các hộ kinh do-", "anh trong tháng này.", "Trang 2", "Phòng kế hoạch điều chỉnh dự toán xây dựng theo quyết định của ủy", "ban.", "Nguyễn Văn A"])
    long = " ".join(words * 6)
    mixed = "\n".join(["SỞ NỘI VỤ TỈNH A", long, "Các đơn vị chủ động kiểm tra thiết bị phòng cháy tại hiện trư-", "ờng trong tuần.", "- 3 -", "Nguyễn Văn A"])
    body = "\n".join(["Các đơn vị chủ động kiểm tra tliiết bị phòng cháy tại hiện trường,", "phòng kế hoạch điều chỉnh dự toán xây dựng theo quyết địnli của ủy ban."])
    rows = [(i, page(rng, set())) for i in range(1, 60)] + [(100, small), (101, mixed), (102, body), (103, "một\nhai\nba")]
    t = labels(rows)
    got = [{r.label_id: (r.repaired, r.n_hyphen, r.n_chars, r.n_header, r.n_pageno) for r in ocr_repair.repair_texts(t.repartition(k, "label_id"), "label_id", "full_text").collect()} for k in (1, 8)]
    assert got[0] == got[1]
    assert got[0][100][1:] == (1, 0, 0, 1) and "kinh doanh" in got[0][100][0] and "của ủy ban." in got[0][100][0]
    assert got[0][101][1] == 1 and got[0][101][4] == 1 and "hiện trường trong tuần." in got[0][101][0] and long in got[0][101][0]
    assert got[0][102][2] == 2 and "thiết bị" in got[0][102][0] and "quyết định" in got[0][102][0]
    assert got[0][103][0] == "một\nhai\nba"
