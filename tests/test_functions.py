"""Golden values of the column functions."""

import random

import pytest
from pyspark.sql import functions as F

from sonmai.functions import dates as D
from sonmai.functions import extract as X
from sonmai.functions import layout as L
from sonmai.functions import metrics as M
from sonmai.functions import text as T
from sonmai.functions import udfs as U



@pytest.mark.parametrize(
    "f, given, want",
    [
        (T.nfc, "e\u0323\u0302", "ệ"), (T.nfc, None, ""), (T.collapse, "hello\t\n  world", "hello world"), (T.collapse, "  a 　b ", "a b"), (T.remove_accents, "Đại học Bách Khoa", "Dai hoc Bach Khoa"),
        (T.remove_accents, "e\u0323\u0302", "e"), (T.plain_punctuation, "“a” – b ,c", '"a"-b, c'), (T.plain_punctuation, "x…", "x. . ."), (T.plain_punctuation, "5 / 6", "5/6"), (T.case_fold, "QUYẾT ĐỊNH", "quyết định"),
        (T.case_fold, "Straße", "strasse"), (T.postprocess, "QUYÊT ĐỊNH Số  :12 V / v : x ,y", "QUYẾT ĐỊNH Số: 12 V/v: x,y"), (T.domain_corrections, "Số 1/Q4-UBND của Iãnh đạo tinh Đắk Lắk (C%)", "Số 1/QĐ-UBND của lãnh đạo tỉnh Đắk Lắk (%)"),
        (T.remove_watermarks, "a\nKý bởi: X\nNgày ký: 1/1\nb", "a\nb"), (T.remove_watermarks, "THỜI GIAN KÝ: 01.02.2020 10:00", ""), (T.prefix_normal, " Số: 12  A", "12 a"), (T.person_line, "Nơi nhận\nNguyễn Văn An\nhà 5", "Nguyễn Văn An"),
        (T.duration_label, 3725, "1h 2m 5s"), (T.duration_label, 59, "59s"), (D.iso_date, "15/03/2024", "2024-03-15"), (D.iso_date, "15-03-2024", "2024-03-15"), (D.iso_date, "32/13/2024", None), (D.iso_date, "ngày 2 tháng 5 năm 2026", "2026-05-02"),
        (D.iso_date, "vào ngày 2 tháng 5 năm 2026", None), (D.iso_date, None, None), (D.day_first, "2024-01-31", "31/01/2024"), (D.day_first, "ngày 1 tháng 2 năm 2024", "01/02/2024"), (D.day_first, "khoảng 3-4-2020", "03/04/2020"), (D.day_first, "?", "?"),
        (D.without_defaults, "01/01/1970", ""), (D.header_date, "Hà Nội, ngày 5\nABC tháng 6 XYZ năm 2021", "05/06/2021"), (D.header_date, "ngày 5 XX 6 năm 2021", "05/06/2021"), (D.first_date, "NGÀY 5 THÁNG 6 NĂM 2021", "05/06/2021"),
        (X.kind_by_search, "thông báo và quyết định", "Quyết định"), (X.kind_by_search, "xin chào", "Khác"), (X.number_by_search, "Số: 123/QĐ-UBND ngày", "123/QĐ-UBND"), (X.subject_by_search, "V/v: nghỉ tết\nx", "nghỉ tết"), (X.number_from_text, "Số: 12\\2020\\QĐ-TTg", "12/2020/QĐ-TTg"),
        (X.signer_from_text, "a b\nNguyễn Văn A\n", ""), (X.signer_from_text, "xong.\nNguyễn Văn An\n", "Nguyễn Văn An"), (X.signer_from_text, "xong.\nNGUYỄN VĂN AN\n", "Nguyễn Văn An"), (X.kind_standing, "UBND\nTHÔNG BÁO\nvề quyết định", "Thông báo"), (X.kind_standing, "một thông báo", ""),
        (X.agency_from_head, "ỦY BAN NHÂN DÂN\nTỈNH ĐẮK LẮK\n", "Ủy ban nhân dân tỉnh Đắk Lắk"), (X.agency_from_head, "BỘ TÀI CHÍNH\n", "Bộ Tài Chính"), (X.agency_from_head, "CHÍNH PHỦ\n", "Chính phủ"), (X.canonical_kind, " QUYẾT ĐỊNH ", "Quyết định"), (X.canonical_kind, None, "Khác"),
        (X.cased_agency, "ỦY BAN NHÂN DÂN TỈNH ĐẮK LẮK", "Ủy ban nhân dân tỉnh Đắk Lắk"), (X.cased_agency, "HỘI ĐỒNG NHÂN DÂN THÀNH PHỐ HUẾ", "Hội đồng nhân dân thành phố Huế"), (X.cased_agency, "BỘ TÀI CHÍNH", "Bộ Tài chính"), (X.cased_agency, "TỔNG CỤC THUẾ", "Tổng cục Thuế"),
        (X.cased_agency, "CHỦ TỊCH ỦY BAN NHÂN DÂN TỈNH A", "Chủ tịch Ủy ban nhân dân tỉnh A"), (X.cased_agency, "VĂN PHÒNG QUỐC HỘI", "Văn phòng Quốc hội"), (X.cased_agency, "Sở Y tế Tỉnh A", "Sở Y tế tỉnh A"), (X.cased_agency, "", ""), (X.cased_agency, None, None),
        (X.clean_subject, "QUYẾT ĐỊNH: V/v: bổ nhiệm", "bổ nhiệm"), (X.clean_signer, "KT. CHỦ TỊCH Nguyễn Văn A", "Nguyễn Văn A"), (X.clean_signer, "CHỦ TỊCH", ""), (X.clean_signer, "Sở Y tế", ""), (X.clean_signer, "N/A", ""), (X.repaired_number, "32025/QĐ", "3/2025/QĐ"),
        (X.repaired_number, "12/2025/QĐ", "12/2025/QĐ"), (X.json_object, 'x ```json {"a": 1} ```', '{"a": 1} '.strip()), (X.json_object, "{bad", None),
    ],
)
def test_scalar(one, f, given, want):
    assert one(f(F.col("x")), x=given) == want


def test_truncation(one):
    assert one(T.truncate_words(F.col("x"), 8), x="một hai ba") == "một hai..."
    assert one(T.truncate_words(F.col("x"), 3), x="abcdef") == "abc..."
    assert one(T.truncate_words(F.col("x"), 30), x="ngắn") == "ngắn"
    assert one(T.truncate_middle(F.col("x"), 6), x="abcdefghij") == "abcd\n...\nij"


def test_body_markers(one):
    body = "x" * 400
    mark = lambda t: one(T.body_markers(F.col("x")), x=t)
    assert mark(body + "\nPHỤ LỤC\n" + "y" * 600) == T.BODY[0] + body + T.BODY[1]
    assert mark("ngắn\nPHỤ LỤC\ny") == "ngắn\nPHỤ LỤC\ny"
    assert mark("PHỤ LỤC\n" + body) == "PHỤ LỤC\n" + body and mark(None) is None
    receivers = body + "\nNơi  nhận:\n- Như trên\n- Lưu: VT" + "z" * 900
    assert mark(receivers) == T.BODY[0] + receivers[: receivers.index("Lưu:") + 4 + 200] + T.BODY[1]
    unfiled = body + "\nNơi nhận: A" + "z" * 900
    assert mark(unfiled) == T.BODY[0] + unfiled[: unfiled.index("nhận:") + 5 + 500] + T.BODY[1]


@pytest.mark.parametrize("text, want", [("Hà Nội, ngày 5/6/2021", "5/6/2021"), ("Ngày 7 tháng 8 năm 2020", "7/8/2020"), ("a\nb 1/2/2019", "1/2/2019"), ("x\n" * 30 + "1/2/2019", ""), ("", "")])
def test_label_date(one, text, want):
    assert one(D.label_date(F.col("x")), x=text) == want


def test_word_edits_equal_the_matrix():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 80 if rng.random() < 0.2 else 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert M.word_edits(a, b) == row[-1]


def test_wer_of_any_length(one):
    assert one(M.wer(F.col("t"), F.col("p")), t=None, p="") == 0 and one(M.wer(F.col("t"), F.col("p")), t=" ", p="a") == 1
    t = " ".join(map(str, range(70_000)))
    assert one(M.wer(F.col("t"), F.col("p")), t=t, p=t.replace(" 5 ", " x y ")) == pytest.approx(2 / 70_000)


def test_reply_dates_and_parts(one):
    r = one(U.reply_fields(F.col("x")), x='{"a": {"số_hiệu": {"0": "1 2/QĐ"}}, "date": "2024-02-01", "bản": {"loại": "Thông báo"}}')
    assert (r.so_hieu, r.ngay_ban_hanh, r.loai_van_ban, r.nguoi_ky) == ("12/QĐ", "01/02/2024", "Thông báo", "")


@pytest.mark.parametrize(
    "p, t, is_date, want",
    [("", "", False, "both_empty"), (None, None, False, "both_empty"), ("", "x", False, "missed"), ("x", " ", False, "extra"), ("QUYẾT ĐỊNH", "quyết định", False, "correct"), ("15/03/2024", "ngày 15 tháng 03 năm 2024", True, "correct"), ("123/QĐ-UBND extra", "123/QĐ-UBND", False, "wrong")],
)
def test_field_status(one, p, t, is_date, want):
    assert one(M.field_status(F.col("p"), F.col("t"), is_date), p=p, t=t) == want


@pytest.mark.parametrize(
    "f, a, b, want",
    [
        (M.token_f1, "", "", 1.0), (M.token_f1, "a", "", 0.0), (M.token_f1, "a a b", "a b b", 2 / 3), (M.token_f1_set, "a a b", "a b b", 1.0), (M.char_similarity, "", "", 1.0), (M.char_similarity, "Việt", "Viet", 0.75), (M.cer, "", "a", 1.0), (M.cer, "abcd", "abed", 0.25),
        (M.wer, "xin chào thế giới", "xin chào", 0.5), (M.wer, "", "", 0.0), (M.cer_stripped, " ab ", "ab", 0.0), (M.char_set_similarity, "ab", "bc", 1 / 3), (U.difflib_ratio, "abcd", "bcde", 0.75), (U.difflib_ratio, None, "", 1.0),
    ],
)
def test_similarities(one, f, a, b, want):
    assert one(f(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_containment(one):
    assert one(M.contained(F.col("a"), F.col("b")), a="123/QĐ-UBND extra", b="123/QĐ-UBND")
    assert not one(M.contained(F.col("a"), F.col("b")), a="", b="x")


def test_json_number(one):
    assert one(M.json_number(F.col("x"), "a.b"), x='{"a": {"b": 1.5}}') == 1.5
    assert one(M.json_number(F.col("x"), "a.b"), x='{"a": {"b": "x"}}') is None
    assert one(M.json_number(F.col("x"), "a"), x='{"a": true}') == 1.0


@pytest.mark.parametrize(
    "t, x, y, want",
    [
        ("", 0, 0, "noi_dung"), ("MẬT", 500, 500, "do_mat_khan"), ("Độc lập - Tự do", 500, 50, "quoc_hieu"), ("Số: 1", 100, 200, "so_hieu"), ("ngày 1 tháng 2 năm 2020", 700, 200, "ngay_ban_hanh"), ("QUYẾT ĐỊNH", 400, 250, "ten_loai"), ("Về việc x", 400, 300, "trich_yeu"),
        ("Nơi nhận:", 100, 800, "noi_nhan"), ("GIÁM ĐỐC", 700, 800, "nguoi_ky"), ("abc", 700, 100, "quoc_hieu"), ("abc", 100, 100, "co_quan"), ("abc", 100, 170, "so_hieu"), ("abc", 700, 170, "ngay_ban_hanh"), ("abc", 100, 250, "ten_loai"), ("abc", 100, 800, "noi_nhan"), ("abc", 700, 800, "nguoi_ky"), ("abc", 500, 500, "noi_dung"),
    ],
)
def test_regions(one, t, x, y, want):
    box = [F.lit(x - 10), F.lit(y - 10), F.lit(x + 10), F.lit(y + 10), F.lit(1000), F.lit(1000)]
    assert one(L.region(F.col("x"), *box), x=t) == want


def test_boxes(one):
    q = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((1, 5), (9, 4), (8, 7), (2, 8))])
    assert tuple(one(L.axis_box(q))) == (1, 4, 9, 8)
    assert tuple(one(L.axis_box(F.array(F.array(F.lit(1), F.lit(2)))))) == (0, 0, 0, 0)
    assert tuple(one(L.clamped(F.lit(-5), F.lit(5), F.lit(99), F.lit(99), F.lit(50), F.lit(60), 10))) == (0, 0, 50, 60)
    assert one(L.yolo_row(F.lit(0), L.centre_size(F.lit(0), F.lit(0), F.lit(50), F.lit(50), F.lit(100), F.lit(100)))) == "0 0.250000 0.250000 0.500000 0.500000"


def test_reading_order(spark):
    rows = [(1, 1, 1, 300, 12, 400, 32), (1, 1, 2, 10, 10, 100, 30), (1, 1, 3, 10, 60, 100, 80)]
    t = spark.createDataFrame(rows, "doc_id int, page int, line_no int, x1 int, y1 int, x2 int, y2 int")
    assert [r.line_no for r in L.with_reading_order(t).orderBy("reading_order").collect()] == [2, 1, 3]


def test_reply_fields(one):
    r = one(U.reply_fields(F.col("x")), x='{"người_ký": {"tên": "A B"}, "Loại": "QĐ", "so": " 1 / 2 ", "noi_dung": ["x", "y"], "subject": "longer one"}')
    assert (r.nguoi_ky, r.loai_van_ban, r.so_hieu, r.trich_yeu, r.ngay_ban_hanh) == ("A B", "QĐ", "1/2", "longer one", "")
    assert one(U.reply_fields(F.col("x")), x="bad").so_hieu == ""


def test_canonical_hash(one):
    assert one(U.canonical_hash(F.col("x"), ("h",)), x='{"b": 1, "a": 2, "h": 3}') == one(U.canonical_hash(F.col("x")), x='{"a":2,"b":1}')
    assert one(U.canonical_hash(F.col("x")), x="{") is None


def test_noise_is_deterministic(one):
    n = lambda: one(T.scan_noise(F.col("x"), F.lit(1), 0.5), x="an toàn đập 2050 lao động")
    assert n() == n() != "an toàn đập 2050 lao động"


def test_masks_and_matting(spark):
    t = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], bytearray([200, 10, 10, 20, 20, 20]))], "a array<double>, b array<double>, p binary")
    r = t.select(U.mask_agreement(F.col("a"), F.col("b")).alias("m"), U.red_matting(F.col("p")).alias("c")).collect()[0]
    assert (r.m.iou, r.m.mse) == (0.5, 0.5) and bytes(r.c) == bytes([255, 255, 255, 20, 20, 20])
