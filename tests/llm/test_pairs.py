"""Near duplicates, overlaps across splits and leaked passages, held against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sonmai.llm import evalleak, jaccard, neardup, splitleak

WORDS = [a + b for a in ("ba", "ca", "đa", "ga", "hà", "lý", "mô", "nê", "pho", "quy") for b in ("n", "ng", "t", "m", "c", "", "i", "o", "p", "u")]


def document(rng, n=150):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))


def reworked(rng, text, share):
    return " ".join("sửa" + str(rng.randint(0, 999)) if rng.random() < share else w for w in text.split())


def shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(w, w[1:], w[2:])) or {tuple(w)}


def brute(rows, least=0.55):
    s = [(i, shingles(t)) for i, t in rows if t and t.strip()]
    return {(a, b) for a, x in s for b, y in s if a < b and len(x & y) >= least * len(x | y)}


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = document(rng)
        rows.append(t)
        if i % 4 == 0:
            rows += [reworked(rng, t, 0.04), reworked(rng, t, 0.08), t]
        if i % 4 == 1:
            rows.append(reworked(rng, t, 0.5))
    return [(i + 1, t) for i, t in enumerate(rows)]


def pairs(df):
    return {(r.a, r.b) for r in neardup.near_duplicates(df, "label_id", "full_text").collect()}


def test_near_duplicates_equal_brute_force(labels):
    rows = corpus()
    extra = [(900, None), (901, ""), (902, "  \n "), (903, "một"), (904, "Một!"), (905, "hai từ"), (906, "x" * 200_000 + " " + rows[0][1]), (907, rows[0][1].upper())]
    want = brute(rows + [x for x in extra if x[0] != 906])
    got = pairs(labels(rows + extra))
    assert {p for p in got if 906 not in p} == want and (903, 904) in got


def test_damage_is_set_aside(labels):
    text = document(random.Random(5), 80)
    lines, line = [], ""
    for w in text.split():
        line = f"{line} {w}".strip()
        if len(line) > 40:
            lines.append(line)
            line = ""
    lines.append(line)
    cut = lines[3][-3:]
    scan = [*lines[:3], lines[3][:-3] + "-", cut.lstrip() + " " + lines[4], "- 2 -", *lines[5:]]
    odd = text.replace("a", "а", 9).replace(" ", " ", 4)
    assert pairs(labels([(1, text), (2, "\n".join(scan)), (3, odd), (4, document(random.Random(6), 80))])) == {(1, 2), (1, 3), (2, 3)}


def test_hot_groups_are_whole(labels):
    """A third of all rows are near copies of one text, a third exact ones: more than a signature's group may hold at once."""
    rng = random.Random(9)
    base = document(rng, 120)
    rows = [(i, reworked(rng, base, 0.02)) for i in range(1, 90)] + [(i, base) for i in range(90, 150)] + [(i, document(rng, 120)) for i in range(150, 200)]
    assert pairs(labels(rows)) == brute(rows)


def test_empty_table_and_classes(labels):
    assert pairs(labels([])) == set()
    rows = corpus(n=8)
    g = {r.id: r for r in neardup.duplicate_groups(labels([*rows, (900, None)]), "label_id", "full_text").collect()}
    assert set(g) == {i for i, _ in rows} and sum(r.n_links for r in g.values()) > 0


def manifest(spark, rows):
    return spark.createDataFrame(rows, "id string, input_path string, input_sha256 string, label_path string, label_sha256 string, split string, source_type string")


def test_overlaps_across_splits(spark, labels):
    rows = corpus(seed=4, n=40)
    stem = {i: f"bench_{i:09d}" for i, _ in rows}
    t = labels(rows).withColumn("filename", F.concat(F.lit("bench_"), F.lpad(F.col("label_id").cast("string"), 9, "0"), F.lit(".jpg")))
    split = {i: ("train", " Test", "val ", None)[i % 4] for i, _ in rows}
    m = [(stem[i], "p", None, None, None, split[i], "scan") for i, _ in rows]
    m += [("scan_1", "p", "AB", None, None, "TRAIN", "fax"), ("scan_2", "p", "ab", None, None, "val", None), ("scan_2", "p", "ab", None, None, "val", None), ("scan_3", "p", None, None, None, "test", "fax"), ("scan_4", "p", "ab", None, None, None, "fax")]
    train = lambda i: split[i] == "train"
    other = lambda i: split[i] in (" Test", "val ")
    want = {(stem[a], stem[b]) for a, b in brute(rows) if train(a) and other(b) or train(b) and other(a)} | {("scan_1", "scan_2")}
    got = [(r.id_a, r.id_b) for r in splitleak.found(manifest(spark, m), t).collect()]
    assert set(got) == want and len(got) == len(want)
    rep = splitleak.report(manifest(spark, m), t).collect()
    assert sum(r.n_overlapping for r in rep) == len({x for p in want for x in p if x == "scan_2" or (x.startswith("bench") and other(int(x[6:])))})
    assert splitleak.found(manifest(spark, []), labels([]).withColumn("filename", F.lit("x.jpg"))).count() == 0


def test_leaked_passages(spark):
    rng = random.Random(2)
    item = "Thuyền chở 53 thùng bình vôi đan lỗi từ Kim Lam sang Hạ Sơn mất ba giờ cờ lam nhạt và hết"
    w = item.split()
    docs = [
        (1, "Xin chào. " + item.upper() + " hết."), (2, "THUYEN, cho - 53\nthung (binh) voi dan  loi tu Kim: Lam, SANG"), (3, " ".join(w[:11]) + " khác"), (4, " ".join(w[3:15])), (5, document(rng)), (6, None), (7, ""),
        (8, " ".join([*w[:6], "sửa", *w[7:14]])), (9, (document(rng) + " ") * 200 + item), (9, item), (10, "một hai"),
    ]
    items = spark.createDataFrame([(1, item, "test"), (2, item, "val"), (3, None, "val"), (4, "một hai", "test")], "item_id long, text string, eval_split string")
    t = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("source", F.lit("s"))
    got = {(r.doc_id, r.item_id) for r in evalleak.found(t, items).collect()}
    assert got == {(d, i) for d in (1, 2, 4, 9) for i in (1, 2)} | {(10, 4)}
    near = {(r.doc_id, r.edits) for r in evalleak.leaks(t, items).collect()}
    assert (3, 1) in near  # a substituted word
    assert evalleak.found(t.where("false"), items).count() == 0 and evalleak.found(t, items.where("false")).count() == 0


def edited_versions(seed, n, words=300):
    """A third of the rows are versions of one text, each with edits of its own in one place; the others share nothing."""
    rng = random.Random(seed)
    base = document(rng, words).split()
    rows = []
    for i in range(n):
        if i % 3:
            rows.append(document(rng, words))
            continue
        at = rng.randrange(words * 7 // 8)
        rows.append(" ".join([*base[:at], *document(rng, words // 8).split(), *base[at + words // 8 :]]))
    return [(i + 1, t) for i, t in enumerate(rows)]


def test_overlaps_of_edited_versions_of_one_text(spark, labels):
    rows = edited_versions(11, 150)
    stem = {i: f"bench_{i:09d}" for i, _ in rows}
    t = labels(rows).withColumn("filename", F.concat(F.lit("bench_"), F.lpad(F.col("label_id").cast("string"), 9, "0"), F.lit(".jpg")))
    m = [(stem[i], "p", None, None, None, ("train", "test")[i % 2], "scan") for i, _ in rows]
    want = {(stem[a], stem[b]) for a, b in brute(rows) if (a + b) % 2}
    assert len(want) > 300 and {(r.id_a, r.id_b) for r in splitleak.found(manifest(spark, m), t).collect()} == want


def test_common_core_and_core_with_insertion(labels):
    """A core that many texts hold, alone, and with insertions of a third and more: what the pairs share is frequent only."""
    rng = random.Random(21)
    core = document(rng, 120)
    rows = [core, *(core + " " + document(rng, rng.randint(60, 95)) for _ in range(30)), *(document(rng, 150) for _ in range(60))]
    rows = [(i + 1, t) for i, t in enumerate(rows)]
    want = brute(rows)
    assert sum(a == 1 for a, _ in want) > 20 and pairs(labels(rows)) == want


def cells(seed=5, each=4, n=200):
    """Sets of rare and frequent features among a background, and the pairs at a similarity of 0.55 to 0.9 for any shares of rare features on both sides."""
    rng = np.random.default_rng(seed)
    common = rng.integers(1, 2**30, 400).astype(np.int32)
    fresh = iter(range(-(2**30), 0))
    rare = lambda k: np.array([next(fresh) for _ in range(k)], np.int32)
    sets = [np.union1d(rng.choice(common, 240, replace=False), rare(60)) for _ in range(300)]
    want = []
    for jac in (0.55, 0.7, 0.9):
        for share_shared in (0.0, 0.25, 0.5, 0.75, 1.0):
            for share_x in (0.0, 0.5, 1.0):
                for share_y in (0.0, 0.5, 1.0):
                    for _ in range(each):
                        shared = int(np.ceil(jac * n))
                        extra = n - shared
                        x_only = int(rng.integers(0, extra + 1))
                        pool = rng.permutation(common)
                        k = [int(shared * share_shared), int(x_only * share_x), int((extra - x_only) * share_y)]
                        f = np.cumsum([0, shared - k[0], x_only - k[1], extra - x_only - k[2]])
                        both = np.r_[pool[f[0] : f[1]], rare(k[0])]
                        x = np.unique(np.r_[both, pool[f[1] : f[2]], rare(k[1])]).astype(np.int32)
                        y = np.unique(np.r_[both, pool[f[2] : f[3]], rare(k[2])]).astype(np.int32)
                        want.append((len(sets), len(sets) + 1))
                        sets += [x, y]
    return sets, want


def known_of(sets, least=4):
    v, n = np.unique(np.concatenate(sets), return_counts=True)
    return v[n >= least], n[n >= least]


def test_no_cell_of_rarity_and_similarity_loses_pairs(spark):
    sets, want = cells()
    known, counts = known_of(sets)
    rows = [(i, s.tobytes()) for i, s in enumerate(sets)]
    t = spark.createDataFrame(rows, "fp long, s binary").repartition(3)
    got = {(r.a, r.b) for r in jaccard.candidates(t, known, counts, 0.55).collect()}
    assert len(want) == 540 and not [p for p in want if p not in got]
    sided = spark.createDataFrame([(i, s, 1 + i % 2) for i, s in rows], "fp long, s binary, side int").repartition(3)
    got = {(r.a, r.b) for r in splitleak.candidates(sided, known, counts / len(sets)).collect()}
    assert not [p for p in want if p not in got]


def test_cosine_floor_holds_for_any_weights():
    rng = np.random.default_rng(1)
    for _ in range(300):
        u = int(rng.integers(20, 300))
        shared = int(np.ceil(0.55 * u))
        x_only = int(rng.integers(0, u - shared + 1))
        w = rng.choice([1.0, splitleak.RATIO], u) if rng.random() < 0.5 else np.r_[np.ones(shared), np.full(u - shared, splitleak.RATIO)]
        x, y = w[: shared + x_only].sum(), w[:shared].sum() + w[shared + x_only :].sum()
        assert w[:shared].sum() / np.sqrt(x * y) >= splitleak.floor() - 1e-9


def test_edited_windows_meet():
    """Recall of one word substituted, inserted or deleted at any place, with 12 words and in longer passages; equal windows always meet."""
    rng = np.random.default_rng(8)
    items = [[f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(12, 20)))] for _ in range(400)]
    it = evalleak.Items(list(enumerate(map(" ".join, items))), evalleak.WINDOW, 1)
    number = lambda ws: np.array([it.vocabulary.get(w, 0) for w in ws], np.int64)
    for kind in ("same", "substituted", "inserted", "deleted"):
        texts = []
        for i, w in enumerate(items):
            w = w[:12]
            at = int(rng.integers(1, 11))
            w = {"same": w, "substituted": [*w[:at], "zz", *w[at + 1 :]], "inserted": [*w[:at], "zz", *w[at:]], "deleted": w[:at] + w[at + 1 :]}[kind]
            texts.append(number(["q", *w, "q"]))
        x, o = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
        got = {(t, i): e for t, i, e, _ in it.matches(x, o)}
        hit = [got.get((i, i)) == (kind != "same") for i in range(len(items))]
        assert all(hit) if kind == "same" else np.mean(hit) >= 0.97, (kind, np.mean(hit))


def test_one_word_items_and_shared_windows():
    it = evalleak.Items([(1, "hello"), (2, "một hai ba bốn năm sáu bảy tám chín mười mươi trăm"), (3, "một hai ba bốn năm sáu bảy tám chín mười mươi trăm nghìn")], 12, 0)
    n = lambda t: np.array([it.vocabulary.get(w, 0) for x in t.split() for w in evalleak.words_of(x)], np.int64)
    texts = [n(""), n("hello"), n("MỘT hai, ba bốn năm sáu bảy tám chín mười mươi trăm hello")]
    x, o = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    assert {m[:3] for m in it.matches(x, o)} == {(1, 1, 0), (2, 1, 0), (2, 2, 0), (2, 3, 0)}
    assert {m[:3] for m in it.matches(n("hello"), np.array([0, 0, 1]))} == {(1, 1, 0)}


def test_blocks_meet_by_classes_of_sizes():
    """All pairs at the threshold, whatever their sizes, with several classes in a block, and no more of the prefixes counted than the sizes need."""
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 4000, int(n))).astype(np.int32) for n in rng.integers(1, 700, 500)]
    near = [np.unique(np.r_[rng.permutation(s)[: max(1, int(len(s) * keep))], rng.integers(4000, 9000, int(len(s) * more))]).astype(np.int32) for s, keep, more in zip(base, rng.uniform(0.5, 1, 500), rng.uniform(0, 0.6, 500))]
    known, counts = known_of(base + near)

    def block(sets):
        sets = sorted(sets, key=len)
        n, v = np.array([len(s) for s in sets]), np.concatenate(sets)
        f, d = jaccard.prefixes(v, np.r_[0, np.cumsum(n)], known, counts, 0.55)
        q, order = np.concatenate([np.arange(k) for k in np.bincount(d, minlength=len(n))]), np.argsort(f, kind="stable")
        return sets, jaccard.opened(n, f[order], d[order], q[order].astype(np.uint16), jaccard.bitmaps(v, n))

    (x, bx), (y, by) = block(base), block(near)
    assert len(bx[2]) > 2
    want = {(i, j) for i, s in enumerate(x) for j, r in enumerate(y) if (c := len(np.intersect1d(s, r, True))) >= 0.55 * (len(s) + len(r) - c)}
    got = set(zip(*(z.tolist() for z in jaccard.meet(bx, by, 0.55))))
    assert len(want) > 100 and want <= got


def test_equal_texts_of_all_tasks_meet_once(labels, monkeypatch):
    rng = random.Random(31)
    texts = [document(rng, 60) for _ in range(20)]
    rows = [(i + 1, texts[i % 20]) for i in range(120)]
    met = []
    monkeypatch.setattr(neardup, "candidates", lambda sets, *a: met.append(sets.count()) or jaccard.candidates(sets, *a))
    assert pairs(labels(rows).repartition(6)) == brute(rows) and met == [20]
