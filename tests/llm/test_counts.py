"""Word pairs count over all rows, however these are spread over tasks."""

from sonmai.llm import ocr_repair


def test_pairs_seen_once_in_each_task_count(labels):
    rows = [(i, f"chung {i} một cặp") for i in range(1, 9)]
    for parts in (1, 8):
        t = labels(rows).repartition(parts, "label_id") if parts == 1 else labels(rows).repartition(parts)
        got = {(r.a, r.b): r.n for r in ocr_repair.corpus_counts(t, "label_id", "full_text").where("kind = 'p'").collect()}
        assert got["một", "cặp"] == 8
