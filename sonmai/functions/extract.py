"""Rule-based extraction and cleaning of header fields (inventory R1-R24)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import day_first, first_date, header_date, without_defaults
from .text import domain_corrections, person_line, strip, text, upper_ratio

# Kinds of documents in the order in which a text is searched for them.
SEARCHED = ("Quyết định", "Nghị quyết", "Chỉ thị", "Nghị định", "Thông tư", "Thông báo", "Công văn", "Công điện", "Luật", "Hợp đồng", "Tờ trình", "Báo cáo", "Biên bản", "Kế hoạch")
STANDING = SEARCHED[:9]
# All kinds of documents.
KINDS = (
    "Quyết định", "Nghị quyết", "Chỉ thị", "Quy chế", "Quy định", "Thông báo", "Hướng dẫn", "Chương trình", "Kế hoạch", "Phương án", "Đề án", "Dự án", "Báo cáo", "Biên bản", "Tờ trình",
    "Hợp đồng", "Công văn", "Công điện", "Giấy mời", "Giấy giới thiệu", "Giấy ủy quyền", "Giấy nghỉ phép", "Phiếu gửi", "Phiếu chuyển", "Phiếu báo", "Thư công", "Bản ghi nhớ", "Bản thỏa thuận",
    "Giấy biên nhận", "Luật", "Nghị định", "Thông tư", "Pháp lệnh", "Lệnh",
)
OTHER = "Khác"
# Bodies whose spelling doesn't follow from their words.
BODIES = {
    "THỦ TƯỚNG CHÍNH PHỦ": "Thủ tướng Chính phủ",
    "CHÍNH PHỦ": "Chính phủ",
    "VĂN PHÒNG CHÍNH PHỦ": "Văn phòng Chính phủ",
    "VĂN PHÒNG QUỐC HỘI": "Văn phòng Quốc hội",
    "QUỐC HỘI": "Quốc hội",
    "NGÂN HÀNG NHÀ NƯỚC VIỆT NAM": "Ngân hàng Nhà nước Việt Nam",
    "NGÂN HÀNG NHÀ NƯỚC": "Ngân hàng Nhà nước Việt Nam",
    "KIỂM TOÁN NHÀ NƯỚC": "Kiểm toán Nhà nước",
    "THANH TRA CHÍNH PHỦ": "Thanh tra Chính phủ",
    "VIỆN KIỂM SÁT NHÂN DÂN TỐI CAO": "Viện kiểm sát nhân dân tối cao",
    "TÒA ÁN NHÂN DÂN TỐI CAO": "Tòa án nhân dân tối cao",
}
# Beginnings of bodies' names, with the number of words before the proper part.
PLACED = ("Ủy ban nhân dân", "Hội đồng nhân dân")
LEVELS = ("thành phố", "thị xã", "thị trấn", "tỉnh", "huyện", "quận", "xã", "phường")
SUBJECTED = ("Tổng cục", "Bộ", "Sở", "Cục")
# Words that fill a signer's place without naming one, offices before a name, and words of bodies.
NO_NAME = ("[Chưa có thông tin]", "[Không tìm thấy]", "[Không rõ]", "[Không xác định]", "Chưa có thông tin", "Không tìm thấy", "N/A", "None", "null", "không rõ")
OFFICES = (
    r"(?:KT\.\s*|TM\.\s*|TL\.\s*|TUQ\.\s*|Q\.\s*)", "(?:CHỦ TỊCH|PHÓ CHỦ TỊCH)", "(?:GIÁM ĐỐC|PHÓ GIÁM ĐỐC|TỔNG GIÁM ĐỐC)", "(?:THỦ TƯỚNG|PHÓ THỦ TƯỚNG)", "(?:BỘ TRƯỞNG|THỨ TRƯỞNG|PHÓ BỘ TRƯỞNG)",
    "(?:CHÁNH VĂN PHÒNG|PHÓ CHÁNH VĂN PHÒNG)", "(?:CHỦ NHIỆM|PHÓ CHỦ NHIỆM)", "(?:ỦY BAN NHÂN DÂN|CHÍNH PHỦ|QUỐC HỘI)", "(?:VĂN PHÒNG)", r"(?:BỘ TRƯỞNG,\s*CHỦ NHIỆM)",
)
BODY_WORDS = ("UBND", "ubnd", "Bộ ", "Sở ", "tỉnh", "thành phố", "Chính phủ", "Quốc hội", "Văn phòng", "Cục ", "Tổng cục", "Hội đồng", "Ban ", "Viện ")


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, NULL for none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it; branches of CASE don't share their parts otherwise."""
    return F.element_at(F.transform(F.array(c), f), 1)


def kind_by_search(c: Column) -> Column:
    """The first kind, in the order of SEARCHED, that the text contains."""

    def first(low: Column) -> Column:
        out = F
        for k in SEARCHED:
            out = out.when(low.contains(k.lower()), k)
        return out.otherwise(OTHER)

    return let(F.lower(c), first)


def number_by_search(c: Column) -> Column:
    return text(_first(c, r"(?U)[Ss]ố[:\s]+(\d+[/\-][A-ZĐa-zđ\d/\-]+)"))


def subject_by_search(c: Column) -> Column:
    return F.left(strip(text(_first(c, r"(?U)[Vv]/[Vv][:\s]+([^\n]+?)(?:\n|\z)"))), F.lit(200))


def by_search(c: Column) -> Column:
    """A struct of the six fields by plain search; agency and signer stay empty."""
    t = text(c)
    return F.struct(
        kind_by_search(t).alias("loai_van_ban"), number_by_search(t).alias("so_hieu"), first_date(t).alias("ngay_ban_hanh"),
        F.lit("").alias("co_quan_ban_hanh"), subject_by_search(t).alias("trich_yeu"), F.lit("").alias("nguoi_ky"),
    )


def longer_subject(subject: Column, title_block: Column) -> Column:
    """The lines after a title, where they say more than the subject at hand."""
    lines = F.filter(F.transform(F.split(text(title_block), "\n"), strip), lambda x: x != "")
    rest = domain_corrections(F.array_join(F.slice(lines, 2, 1000), " "))
    return F.when(F.length(rest) > F.length(text(subject)), rest).otherwise(subject)


def agency_from_block(agency: Column, block: Column) -> Column:
    """Where the agency is missing, the lines of its block that don't begin with a number."""
    lines = F.filter(F.transform(F.split(text(block), "\n"), strip), lambda x: ~x.rlike(r"^\d+[\\/]") & (x != ""))
    return F.when(text(agency) == "", F.array_join(lines, " ")).otherwise(agency)


def number_from_text(c: Column) -> Column:
    """With a year first, then in general; back-slashes turn."""
    a = _first(c, r"(?U)[Ss]ố[:\s]+(\d+[\\/]\d{4}[\\/][A-ZĐa-zđ\d\-]+)")
    b = _first(c, r"(?U)[Ss]ố[:\s]+(\d+[\\/][A-ZĐa-zđ\d\-]+[\\/]?[A-ZĐa-zđ\d\-]*)")
    return text(F.replace(F.coalesce(a, b), F.lit("\\"), F.lit("/")))


def signer_from_text(c: Column) -> Column:
    """The last line of the tail that is a name, in title case first, then in capitals."""
    tail = F.right(text(c), F.lit(4000))
    titled = F.regexp_extract_all(tail, F.lit(r"(?mU)^[ \t]*(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,5})[ \t]*$"), 1)
    capital = F.regexp_extract_all(tail, F.lit(r"(?mU)^[ \t]*(\p{Lu}{2,}(?: \p{Lu}+){1,4})[ \t]*$"), 1)
    return text(F.coalesce(F.try_element_at(titled, F.lit(-1)), F.initcap(F.try_element_at(capital, F.lit(-1)))))


def kind_standing(c: Column) -> Column:
    """The first kind, in order, that stands alone on a line of the beginning."""
    head = F.upper(F.left(text(c), F.lit(3000)))
    out = F
    for k in STANDING:
        out = out.when(head.rlike(r"(?U)(?:^|\n)\s*" + k.upper() + r"\s*(?:\n|\z)"), k)
    return out.otherwise("")


def agency_from_head(c: Column) -> Column:
    """Bodies named in the head of a text, in order of precedence."""
    head = F.upper(F.left(text(c), F.lit(2000)))
    people = r"(?U)ỦY\s*BAN\s*NHÂN\s*DÂN\s*\n\s*(TỈNH|THÀNH\s*PHỐ)\s+([\p{Lu} ]+?)\s*(?:\n|CỘNG)"
    ministry = r"(?U)(?:^|\n)\s*BỘ\s+([\p{Lu} ]+?)\s*(?:\n|CỘNG)"
    level = F.when(F.regexp_extract(head, people, 1) == "TỈNH", "tỉnh").otherwise("thành phố")
    out = F.when(head.rlike(people), F.concat_ws(" ", F.lit(PLACED[0]), level, F.initcap(strip(F.regexp_extract(head, people, 2)))))
    out = out.when(head.rlike(ministry), F.concat(F.lit("Bộ "), F.initcap(strip(F.regexp_extract(head, ministry, 1)))))
    for k in ("THỦ TƯỚNG CHÍNH PHỦ", "VĂN PHÒNG CHÍNH PHỦ", "VĂN PHÒNG QUỐC HỘI", "CHÍNH PHỦ", "QUỐC HỘI"):
        out = out.when(head.rlike(r"(?U)(?:^|\n)\s*" + k.replace(" ", r"\s*") + r"\s*(?:\n|\z)"), BODIES[k])
    return out.otherwise("")


def canonical_kind(c: Column) -> Column:
    """The kind of the list that equals the value but for case, else the word for others."""
    table = F.create_map(*[F.lit(x) for k in KINDS for x in (k.lower(), k)])
    return F.coalesce(F.element_at(table, F.lower(strip(text(c)))), F.lit(OTHER))


def _sentence(c: Column) -> Column:
    """Small letters, the first one capital."""
    low = F.lower(c)
    return F.concat(F.upper(F.left(low, F.lit(1))), F.substring(low, 2, 1 << 30))


def cased_agency(c: Column) -> Column:
    """A name in capitals in the spelling of names; mixed case stays but for the levels. NULL and blanks stay."""
    name = strip(c)
    direct = F.element_at(F.create_map(*[F.lit(x) for kv in BODIES.items() for x in kv]), F.upper(name))
    mixed = F.regexp_replace(F.regexp_replace(name, r"(?U)\bTỈnh\b|\bTỉnh\b", "tỉnh"), r"(?iU)\bthành phố\b", "thành phố")
    chair = F.upper(name).startswith("CHỦ TỊCH ")
    rest = F.when(chair, F.substring(name, 10, 1 << 30)).otherwise(name)
    up = F.upper(rest)
    out = F.when(F.element_at(F.create_map(*[F.lit(x) for kv in BODIES.items() for x in kv]), up).isNotNull(), F.element_at(F.create_map(*[F.lit(x) for kv in BODIES.items() for x in kv]), up))
    for kind in PLACED:
        after = strip(F.substring(rest, len(kind) + 1, 1 << 30))
        level = _first(F.lower(after), r"(?U)^(" + "|".join(LEVELS) + r")\s", 1)
        placed = F.concat_ws(" ", F.lit(kind), level, F.initcap(strip(F.substr(after, F.length(level) + 1, F.lit(1 << 30)))))
        out = out.when(up.startswith(kind.upper() + " "), F.when(level.isNotNull(), placed).otherwise(F.concat(F.lit(kind + " "), _sentence(after))))
    for kind in SUBJECTED:
        out = out.when(up.startswith(kind.upper() + " "), F.concat(F.lit(kind + " "), _sentence(strip(F.substring(rest, len(kind) + 1, 1 << 30)))))
    proper = F.concat(F.when(chair, "Chủ tịch ").otherwise(""), out.otherwise(_sentence(rest)))
    return F.when(text(name) == "", c).when(direct.isNotNull(), direct).when(upper_ratio(name) < 0.7, mixed).otherwise(proper)


def clean_subject(c: Column) -> Column:
    """Without the kind of document or the label before it."""
    t = F.regexp_replace(text(c), "^(?:" + "|".join(x for k in KINDS for x in (k, k.upper())) + r")[ :.\n]*", "")
    return strip(F.regexp_replace(t, r"(?iU)^V\s*/\s*v\s*[:\s]+", ""))


def clean_signer(c: Column) -> Column:
    """Without placeholders, offices and signature marks; '' unless a person's name is left."""
    t = strip(text(c))
    t = F.when(F.lower(t).isin(*[x.lower() for x in NO_NAME]), "").otherwise(t)
    for p in OFFICES:
        t = strip(F.regexp_replace(t, r"(?iU)^\s*" + p + r"\s*", ""))
    t = strip(F.regexp_replace(t, r"(?iU)(?:Ký bởi:|Ngày ký:|Ký số bởi)[^\n]*", ""))

    def person(t: Column) -> Column:
        n = F.size(F.split(F.regexp_replace(t, r"(?U)\s+", " "), " "))
        body = F.lit(False)
        for k in BODY_WORDS:
            body = body | t.contains(k)
        return F.when((n >= 2) & (n <= 6) & (F.length(t) <= 50) & ~t.rlike(r"\d") & ~body, t).otherwise("")

    return let(t, person)


def repaired_number(c: Column) -> Column:
    """A number that a year was stuck to."""
    return F.regexp_replace(text(c), r"^(\d{1,3})(20\d{2})/(.+)\z", "$1/$2/$3")


def json_object(c: Column) -> Column:
    """From the first brace to the last, code fences gone; NULL unless it parses."""
    t = F.regexp_replace(text(c), r"```(?:json)?", "")
    body = _first(t, r"(?s)(\{.*\})")
    return F.when(F.try_parse_json(body).isNotNull(), body)


def response_fields(c: Column) -> Column:
    """The six fields of a reply as a struct; missing ones are NULL."""
    return F.from_json(json_object(c), "loai_van_ban string, so_hieu string, ngay_ban_hanh string, co_quan_ban_hanh string, trich_yeu string, nguoi_ky string")


def subject_from_text(c: Column) -> Column:
    """Labelled, worded, or the first long line."""
    t = text(c)
    long = F.try_element_at(F.filter(F.transform(F.split(t, "\n"), strip), lambda x: F.length(x) >= 30), F.lit(1))
    return F.left(text(F.coalesce(_first(t, r"(?iU)V/v[:\s]+([^\n]+)"), _first(t, r"(?iU)(Về việc[^\n]+)"), long)), F.lit(200))


def validated(fields: Column) -> Column:
    """The six fields of a struct in their output form."""
    g = fields.getField
    return F.struct(
        canonical_kind(g("loai_van_ban")).alias("loai_van_ban"), repaired_number(g("so_hieu")).alias("so_hieu"), without_defaults(day_first(text(g("ngay_ban_hanh")))).alias("ngay_ban_hanh"),
        text(cased_agency(g("co_quan_ban_hanh"))).alias("co_quan_ban_hanh"), clean_subject(g("trich_yeu")).alias("trich_yeu"), clean_signer(g("nguoi_ky")).alias("nguoi_ky"),
    )


def enriched(fields: Column, full_text: Column) -> Column:
    """What the fields miss, from the whole text."""
    g = lambda k: text(fields.getField(k))
    t = text(full_text)
    fill = lambda k, c: F.when(g(k) == "", c).otherwise(g(k)).alias(k)
    standing = kind_standing(t)
    return F.struct(
        F.when(g("loai_van_ban").isin("", OTHER) & (standing != ""), standing).otherwise(g("loai_van_ban")).alias("loai_van_ban"),
        fill("so_hieu", number_from_text(t)), fill("ngay_ban_hanh", first_date(t)), fill("co_quan_ban_hanh", agency_from_head(t)), g("trich_yeu").alias("trich_yeu"), fill("nguoi_ky", signer_from_text(t)),
    )


def header_override(fields: Column, full_text: Column) -> Column:
    """What the head of the text says wins: number and date always, kind and agency where they are open, a subject that begins amiss, a signer that is too long."""
    g = lambda k: text(fields.getField(k))
    t = text(full_text)
    head = F.left(t, F.lit(1500))
    number, date, kind, agency = number_from_text(head), header_date(head), kind_standing(head), agency_from_head(head)
    subject = subject_from_text(head)
    amiss = (g("trich_yeu") == "") | g("trich_yeu").rlike(r"^\p{Ll}|^này|(?iu)^phụ lục")
    return F.struct(
        F.when(g("loai_van_ban").isin("", OTHER) & (kind != ""), kind).otherwise(g("loai_van_ban")).alias("loai_van_ban"),
        F.when(number != "", number).otherwise(g("so_hieu")).alias("so_hieu"), F.when(date != "", date).otherwise(g("ngay_ban_hanh")).alias("ngay_ban_hanh"),
        F.when(g("co_quan_ban_hanh").isin("", OTHER), agency).otherwise(g("co_quan_ban_hanh")).alias("co_quan_ban_hanh"),
        F.when(amiss & (F.length(subject) > 10), subject).otherwise(g("trich_yeu")).alias("trich_yeu"),
        F.when((g("nguoi_ky") == "") | (F.length(g("nguoi_ky")) > 30), signer_from_text(t)).otherwise(g("nguoi_ky")).alias("nguoi_ky"),
    )


def weak_labels(full_text: Column) -> Column:
    """Labels of a plain text by the same rules, the signer by its look."""
    t = text(full_text)
    return F.struct(
        kind_by_search(t).alias("loai_van_ban"), number_from_text(t).alias("so_hieu"), header_date(t).alias("ngay_ban_hanh"), agency_from_head(t).alias("co_quan_ban_hanh"),
        subject_from_text(t).alias("trich_yeu"), person_line(t).alias("nguoi_ky"),
    )
