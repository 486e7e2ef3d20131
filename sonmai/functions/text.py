"""Text normalization as Column functions (inventory N1-N22). NULL counts as the empty text unless said otherwise.

Every pattern is Unicode-aware. All functions are built-in expressions; nfc() alone needs Python, and sends it only texts
with combining marks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Quotes, dashes and full-width signs with their plain forms.
PUNCTUATION = {"“": '"', "”": '"', "„": '"', "‟": '"', "‚": "'", "‛": "'", "–": "-", "—": "-", "−": "-", "，": ",", "：": ":", "；": ";", "！": "!", "？": "?", "（": "(", "）": ")", "／": "/"}
ELLIPSIS = ("…", "...")
# Phrases misread by optical recognition, in the order in which they are replaced.
PHRASES = {
    "Cộng hòa xã hội chủ nghĩa Việt nam": "Cộng hòa xã hội chủ nghĩa Việt Nam",
    "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAm": "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM",
    "ĐỘC LẬP - Tự DO - HẠNH PHÚC": "ĐỘC LẬP - TỰ DO - HẠNH PHÚC",
    "QUYỂT ĐINH": "QUYẾT ĐỊNH",
    "QUYỂT ĐỊNH": "QUYẾT ĐỊNH",
    "QUYÉT ĐỊNH": "QUYẾT ĐỊNH",
    "QUYÊT ĐỊNH": "QUYẾT ĐỊNH",
    "THÔNG TU": "THÔNG TƯ",
    "THONG TƯ": "THÔNG TƯ",
    "NGHỊ ĐINH": "NGHỊ ĐỊNH",
    "NGHI ĐỊNH": "NGHỊ ĐỊNH",
    "TỜ TRINH": "TỜ TRÌNH",
    "HỢP ĐÔNG": "HỢP ĐỒNG",
    "Giám dốc": "Giám đốc",
    "Phó Giám dốc": "Phó Giám đốc",
    "Chủ tich": "Chủ tịch",
    "Phó Chủ tich": "Phó Chủ tịch",
    "Thứ truởng": "Thứ trưởng",
    "Bộ truởng": "Bộ trưởng",
    "Uỷ ban nhân dân": "Ủy ban nhân dân",
    "UỶ BAN NHÂN DÂN": "ỦY BAN NHÂN DÂN",
}
# Beginnings of words in which a capital I was read for a small l, and of province names.
I_FOR_L = ("ệ", "ê", "ý", "ả", "à", "á", "ạ", "ự", "ầ", "ập", "uật", "ưu", "ực", "ịch", "ương", "ệnh", "ãnh", "ợi")
PROVINCES = ("Đắk", "Phú", "Bình", "Quảng", "Nghệ", "Hà", "Bắc", "Nam", "Lào", "Gia", "Kon", "Đồng", "Hưng", "Thái", "Thanh", "Vĩnh", "Yên", "Tây", "Ninh", "Lâm", "Khánh", "An", "Hải", "Trà", "Long", "Sóc", "Cà", "Bến", "Tiền", "Kiên", "Hậu")
# Marks that digital signatures leave in a text.
WATERMARKS = (
    r"(?isu)Người ký:\s*CỔNG THÔNG TIN ĐIỆN TỬ CHÍNH PHỦ.*?(?:Thời gian ký:[\d\s:\+\-]+|\z)",
    r"(?isu)CHINHPHU\.VN.*?(?:chinhphu\.\w+|\+07:00)",
    r"(?s)VGP.*?(?:chinhphu\.\w+|Email:.*?\n)",
    r"(?iu)THỜI GIAN K[YÝ]:\s*[\d\.:\s\+\-]+",
    r"(?isu)Ký bởi:.*?(?:Ngày ký:.*?(?:\n|\z)|\z)",
    r"(?s)Người ký:\s*CỔNG THÔNG TIN.*?(?:\+07:00|\z)",
    r"(?iu)CỔNG THÔNG TIN ĐIỆN TỬ CHÍNH PHỦ[^\n]*?(?:\n|\z)",
    r"(?iu)G[?.]NG TH[?.]NG TIN[^\n]*?(?:\n|\z)",
    r"(?iu)(?:D\?N GAY|ĐƯN GÀY|D.N GAY)\s*[\d/]+",
)
WS = r"(?U)\s"


def text(c: Column) -> Column:
    """NULL as the empty text."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def nfc(c: Column) -> Column:
    """Composed form; only texts with combining marks leave the JVM."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    t = text(c)
    marked = t.rlike(r"\p{M}")
    return F.when(marked, composed(F.when(marked, t))).otherwise(t)


def collapse(c: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def plain_punctuation(c: Column) -> Column:
    """Plain quotes and dashes, no blank before and one after signs."""
    t = F.translate(collapse(c), "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
    t = F.replace(t, F.lit(ELLIPSIS[0]), F.lit(ELLIPSIS[1]))
    t = F.regexp_replace(t, r"(?U)\s+([,.;:!?/\-])", "$1")
    t = F.regexp_replace(t, r"(?U)([(/\-])\s+", "$1")
    t = F.regexp_replace(t, r"(?U)([,.;:!?])(?!\s|\z)", "$1 ")
    return collapse(t)


def case_fold(c: Column) -> Column:
    """Plain punctuation in folded case."""
    return F.replace(F.lower(plain_punctuation(c)), F.lit("ß"), F.lit("ss"))


def _accents() -> tuple[str, str]:
    plain = {}
    for o in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        d = unicodedata.normalize("NFD", chr(o))
        if len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            plain[chr(o)] = d[0]
    plain |= {"đ": "d", "Đ": "D"}
    return "".join(plain), "".join(plain.values())


ACCENTED, UNACCENTED = _accents()


def remove_accents(c: Column) -> Column:
    """Letters without marks, đ as d; decomposed marks go too."""
    return F.regexp_replace(F.translate(text(c), ACCENTED, UNACCENTED), r"\p{Mn}", "")


def normalize(c: Column, accent_insensitive: bool = False) -> Column:
    """The canonical form in which values are compared."""
    t = case_fold(c)
    return collapse(remove_accents(t)) if accent_insensitive else t


def replace_phrases(c: Column, phrases: Mapping[str, str] = PHRASES) -> Column:
    """Exact phrases one after the other."""
    for wrong, right in phrases.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def postprocess(c: Column) -> Column:
    """Phrases, number and subject labels, blanks before signs. NULL and '' stay."""
    t = replace_phrases(c)
    t = F.regexp_replace(t, r"(?U)Số\s*:\s*", "Số: ")
    t = F.regexp_replace(t, r"(?U)[Vv]\s*/\s*[Vv]\s*:", "V/v:")
    t = strip(F.regexp_replace(t, r"[ \t]+", " "))
    return F.regexp_replace(t, r"(?U)\s+([.,;:!?])", "$1")


def remove_watermarks(c: Column) -> Column:
    """The text without the marks of digital signatures."""
    for p in WATERMARKS:
        c = F.regexp_replace(c, p, "")
    return strip(c)


def domain_corrections(c: Column) -> Column:
    """Letters misread in numbers and words of the domain, then watermarks."""
    t = F.replace(F.replace(c, F.lit("Q4-"), F.lit("QĐ-")), F.lit("N4-CP"), F.lit("NĐ-CP"))
    t = F.regexp_replace(t, r"(?U)(?<=\s|\p{Ll})I(?=" + "|".join(I_FOR_L) + ")", "l")
    t = F.regexp_replace(t, r"(?U)(?:tính|tinh)(\s+(?:" + "|".join(PROVINCES) + "))", "tỉnh$1")
    t = F.regexp_replace(t, "địa bàn t(?:ính|inh)", "địa bàn tỉnh")
    return remove_watermarks(F.replace(t, F.lit("(C%)"), F.lit("(%)")))


def born_digital(c: Column) -> Column:
    """Enough text is left once watermarks are gone."""
    return F.length(remove_watermarks(text(c))) > 100


def simple_normal(c: Column) -> Column:
    """N12, first kind: stripped, small letters, single blanks."""
    return collapse(F.lower(text(c)))


def prefix_normal(c: Column, prefixes: Iterable[str] = ("số: ", "số:", "ngày ", "v/v ")) -> Column:
    """N12, third kind: small letters, each label cut off in turn, one pass over double blanks."""
    t = F.lower(strip(text(c)))
    for p in prefixes:
        t = F.when(t.startswith(p), F.substring(t, len(p) + 1, 1 << 30)).otherwise(t)
    return F.replace(t, F.lit("  "), F.lit(" "))


def truncate_words(c: Column, budget: int) -> Column:
    """At most budget characters, cut at the last blank or line end before, then dots."""
    head = F.left(c, F.lit(budget))
    at = F.regexp_extract(head, r"(?s)^(.*)[ \n]", 1)
    return F.when(F.length(c) <= budget, c).otherwise(F.concat(F.when(at != "", at).otherwise(head), F.lit("...")))


def truncate_middle(c: Column, budget: int) -> Column:
    """The first two thirds of the budget, dots on a line, the last third."""
    head = budget * 2 // 3
    return F.when(F.length(c) <= budget, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit("\n...\n"), F.right(c, F.lit(budget - head))))


# Headings an appendix begins with, and what stands around the main body.
APPENDIX = (r"(?U)\n\s*(?:PHỤ LỤC|Phụ lục)\b", r"(?U)\n\s*CÁC MẪU VĂN BẢN\b", r"(?U)\n\s*DANH MỤC\b")
BODY = ("[VĂN BẢN CHÍNH]\n", "\n[KẾT THÚC VĂN BẢN CHÍNH]\n(Phần phụ lục/mẫu đơn đính kèm đã được lược bỏ — KHÔNG trích xuất từ phần này)")


def body_markers(c: Column) -> Column:
    """The main body between markers where more than 200 characters behind it can be left out, else the text.

    It ends 200 characters behind the filing note after the receivers, 500 behind the receivers without such a note, or at
    the appendix, whichever comes first; an appendix begins after 30 % of the text.
    """
    n = F.length(c)
    at = lambda t, p: F.regexp_instr(t, F.lit(p)) - 1
    appendix = F.least(*[F.when((at(c, p) >= 0) & (at(c, p) > n * 0.3), at(c, p)).otherwise(n) for p in APPENDIX], n)
    receivers, note = r"(?U)Nơi\s+nhận\s*:", r"(?U)Lưu\s*:"
    begin = at(c, receivers)
    end = begin + F.length(F.regexp_extract(c, receivers, 0))
    rest = F.substr(c, end + 1, F.lit(1000))
    behind = F.when(at(rest, note) >= 0, at(rest, note) + F.length(F.regexp_extract(rest, note, 0)) + 200).otherwise(500)
    cut = F.when(begin < 0, appendix).when(begin < appendix, F.least(end + behind, appendix)).otherwise(n)
    return F.when(cut < n - 200, F.concat(F.lit(BODY[0]), strip(F.substr(c, F.lit(1), cut)), F.lit(BODY[1]))).otherwise(c)


def words(c: Column) -> Column:
    """The words between white space; none for a blank text."""
    t = collapse(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_count(c: Column) -> Column:
    """N16."""
    return F.size(words(c))


# What characters turn into under scanning noise.
NOISE = {"a": "á", "ă": "a", "â": "a", "đ": "d", "ê": "e", "ô": "o", "ơ": "o", "ư": "u", "0": "O", "1": "l", "5": "S", "8": "B", "l": "1", "o": "0"}


def scan_noise(c: Column, key: Column, share: float = 0.03, table: Mapping[str, str] = NOISE, seed: int = 42) -> Column:
    """Each character of the table is replaced with this probability, by a hash of key, place and seed."""
    to = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    pick = lambda i: F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return F.array_join(F.transform(F.split(c, ""), lambda x, i: F.when(pick(i), F.coalesce(F.element_at(to, x), x)).otherwise(x)), "")


def title_case(c: Column) -> Column:
    """N18."""
    return F.initcap(c)


def person_line(c: Column) -> Column:
    """The last of the last ten lines that looks like a person's name."""
    lines = F.transform(F.split(c, "\n"), strip)
    tail = F.slice(lines, F.greatest(F.size(lines) - 9, F.lit(1)), F.lit(10))
    ok = F.filter(tail, lambda x: (F.length(x) < 50) & x.rlike(r"^(?:\p{Lu}\S*)(?: \p{Lu}\S*){1,4}$") & ~x.rlike(r"\d"))
    return text(F.try_element_at(ok, F.lit(-1)))


def upper_ratio(c: Column) -> Column:
    """The share of capitals among letters; NULL without letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) / F.nullif(letters, F.lit(0))


def prompt(template: str, **columns: Column) -> Column:
    """A template with named places filled."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), text(c))
    return out


def size_label(c: Column) -> Column:
    """Kilobytes with one decimal."""
    return F.concat(F.round(c / 1024, 1).cast("string"), F.lit(" KB"))


def duration_label(c: Column) -> Column:
    """Hours, minutes and seconds."""
    s = F.floor(c).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long")
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, F.pmod(s, F.lit(60)))).when(m > 0, F.format_string("%dm %ds", m, F.pmod(s, F.lit(60)))).otherwise(F.format_string("%ds", s))


def confidence_level(c: Column) -> Column:
    """N22."""
    return F.when(c >= 95, "high").when(c >= 80, "medium").otherwise("low")
