"""Geometry of recognized lines and boxes (inventory L1-L8, J10, J12, W1, F12-F14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import strip, text

# What lines of a region begin with or contain.
SECRECY = r"(?iuU)^(?:HỎA\s*TỐC|THƯỢNG\s*KHẨN|KHẨN|MẬT|TUYỆT\s*MẬT|TỐI\s*MẬT)\z"
MOTTO = r"(?iuU)CỘNG\s*H[OÒ]A\s*X[AÃ]\s*H[OỘ]I|Độc\s*lập|Tự\s*do|Hạnh\s*phúc"
NUMBER = r"(?iuU)^(?:Số\s*[:：]|\d+\s*/\s*[A-ZĐ])"
DATE = r"(?iuU)ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}"
TITLE = r"(?iuU)^(?:QUYẾT\s*ĐỊNH|NGHỊ\s*ĐỊNH|THÔNG\s*TƯ|THÔNG\s*BÁO|CÔNG\s*VĂN|TỜ\s*TRÌNH|BÁO\s*CÁO|HỢP\s*ĐỒNG|BIÊN\s*BẢN|CHỈ\s*THỊ)\b"
SUBJECT = r"(?iuU)^(?:V\s*/\s*[Vv]\s*[:：]|Về\s+việc\b)"
RECEIVERS = r"(?iuU)^(?:Nơi\s*nhận\s*[:：]|-\s*Như\s*trên|-\s*Lưu\s*[:：])"
SIGNER = r"(?iuU)^(?:KT\.|TM\.|TL\.|TUQ\.|CHỦ\s*TỊCH|GIÁM\s*ĐỐC|BỘ\s*TRƯỞNG|THỦ\s*TƯỚNG|PHÓ)"


def region(line: Column, x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """L1: the region of a line by what it says, then by where its centre lies on the page."""
    t = strip(text(line))
    cx, cy = (x1 + x2) / 2 / F.greatest(width, F.lit(1)), (y1 + y2) / 2 / F.greatest(height, F.lit(1))
    said = (
        F.when(t == "", "noi_dung")
        .when(t.rlike(SECRECY), "do_mat_khan")
        .when(t.rlike(MOTTO) & (cy < 0.15), "quoc_hieu")
        .when(t.rlike(NUMBER) & (cy < 0.22), "so_hieu")
        .when(t.rlike(DATE) & (cy < 0.22), "ngay_ban_hanh")
        .when(t.rlike(TITLE) & (cy < 0.30), "ten_loai")
        .when(t.rlike(SUBJECT) & (cy < 0.35), "trich_yeu")
        .when(t.rlike(RECEIVERS) & (cy > 0.65), "noi_nhan")
        .when(t.rlike(SIGNER) & (cy > 0.65), "nguoi_ky")
    )
    lies = (
        said.when(cy < 0.15, F.when(cx > 0.40, "quoc_hieu").otherwise("co_quan"))
        .when(cy < 0.20, F.when(cx < 0.45, "so_hieu").otherwise("ngay_ban_hanh"))
        .when(cy < 0.28, "ten_loai")
        .when(cy > 0.72, F.when(cx < 0.45, "noi_nhan").otherwise("nguoi_ky"))
    )
    return lies.otherwise("noi_dung")


# The regions of a page, with the numbers and names of their places in a document.
REGIONS = {
    "quoc_hieu": ("1", "Quốc hiệu và Tiêu ngữ"),
    "co_quan": ("2", "Tên cơ quan, tổ chức ban hành"),
    "so_hieu": ("3", "Số, ký hiệu văn bản"),
    "ngay_ban_hanh": ("4", "Địa danh và thời gian ban hành"),
    "ten_loai": ("5a", "Tên loại văn bản"),
    "trich_yeu": ("5b", "Trích yếu nội dung"),
    "noi_dung": ("6", "Nội dung văn bản"),
    "nguoi_ky": ("7a-c", "Chức vụ, chữ ký, họ tên người ký"),
    "con_dau": ("8", "Dấu cơ quan, tổ chức"),
    "noi_nhan": ("9a-b", "Nơi nhận"),
    "do_mat_khan": ("10a-b", "Dấu chỉ độ mật, độ khẩn"),
    "phu_tro": ("11-14", "Thông tin phụ trợ hành chính"),
}
#: The regions whose texts become fields.
FIELD_REGIONS = ("quoc_hieu", "co_quan", "so_hieu", "ngay_ban_hanh", "ten_loai", "trich_yeu", "noi_dung", "nguoi_ky", "noi_nhan")


def classified(lines: DataFrame, width: Column, height: Column) -> DataFrame:
    """Lines (text, x1, y1, x2, y2) with their region, its number and its name; '?' and the region itself for unknown ones."""
    table = lambda i: F.create_map(*[F.lit(x) for k, v in REGIONS.items() for x in (k, v[i])])
    t = lines.withColumn("region", region(F.col("text"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), width, height))
    r = F.col("region")
    return t.withColumns({"region_id": F.coalesce(F.element_at(table(0), r), F.lit("?")), "region_name": F.coalesce(F.element_at(table(1), r), r)})


def region_fields(lines: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), order: str = "line_no") -> DataFrame:
    """L3: the texts of the nine regions of each page as columns, their lines in order; '' where a page has none. A group is a page."""
    joined = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("region") == k, F.struct(order, "text")))), lambda x: x["text"]), "\n")
    return lines.groupBy(*keys).agg(*[strip(joined(k)).alias(f"{k}_text") for k in FIELD_REGIONS])


def fuller_reading(first: Column, second: Column, least: int = 3) -> Column:
    """The lines of a second engine where the first has fewer than least and the second has more."""
    return F.when((F.size(first) < least) & (F.size(second) > F.size(first)), second).otherwise(first)


def axis_box(quad: Column) -> Column:
    """L4: the box around four points [[x, y], …]; zeros for anything else."""
    ok = F.size(quad) == 4
    side = lambda f, i: F.when(ok, f(F.transform(quad, lambda p: F.element_at(p, i))).cast("int")).otherwise(0)
    return F.struct(side(F.array_min, 1).alias("x1"), side(F.array_min, 2).alias("y1"), side(F.array_max, 1).alias("x2"), side(F.array_max, 2).alias("y2"))


def with_reading_order(lines: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), line: str = "line_no") -> DataFrame:
    """row_id and reading order of lines with x1, y1, x2, y2.

    In the order of their tops, a line begins a new row where its centre is at least half the mean height of lines away
    from the line before; rows are read from the left. Windows are partitioned by page, so no group is larger than a page.
    """
    page = Window.partitionBy(*keys)
    down = page.orderBy("y1", line)
    mid = (F.col("y1") + F.col("y2")) / 2
    height = F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1"))
    t = lines.withColumn("_mid", mid).withColumn("_h", F.coalesce(F.avg(height).over(page), F.lit(30.0)))
    t = t.withColumn("_new", F.when(F.abs(F.col("_mid") - F.lag("_mid").over(down)) >= 0.5 * F.col("_h"), 1).otherwise(0))
    t = t.withColumn("row_id", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return t.withColumn("reading_order", F.row_number().over(page.orderBy("row_id", "x1", line))).drop("_mid", "_h", "_new")


def clamped(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: int = 0) -> Column:
    """a box, padded, within the page."""
    z = F.lit(0)
    return F.struct(F.greatest(z, x1 - pad).alias("x1"), F.greatest(z, y1 - pad).alias("y1"), F.least(width, x2 + pad).alias("x2"), F.least(height, y2 + pad).alias("y2"))


def centre_size(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Centre and size as shares of the page, kept within 0.001 and 0.999."""
    keep = lambda c: F.least(F.greatest(c, F.lit(0.001)), F.lit(0.999))
    return F.struct(keep((x1 + x2) / 2 / width).alias("xc"), keep((y1 + y2) / 2 / height).alias("yc"), keep((x2 - x1) / width).alias("w"), keep((y2 - y1) / height).alias("h"))


def percent_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Left, top, width and height in percent of the image."""
    return F.struct((100.0 * x1 / width).alias("left"), (100.0 * y1 / height).alias("top"), (100.0 * (x2 - x1) / width).alias("width"), (100.0 * (y2 - y1) / height).alias("height"))


def yolo_row(cls: Column, box: Column) -> Column:
    """A label row of class and box as text."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, box["xc"], box["yc"], box["w"], box["h"])
