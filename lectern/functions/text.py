"""Column expressions over text. All stay JVM-side; each returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The CJK block that counts as Chinese text, and the share above which a text is "zh".
CJK = "一-鿿"
ZH_SHARE = 0.3

WORD = rf"[\p{{L}}\p{{N}}_&&[^{CJK}]]+"
CJK_RUN = rf"[{CJK}]+"
# A unit is one CJK character or one blank-separated word, together with the blanks behind it,
# so joining consecutive units gives back the text they were cut from.
UNIT = rf"(?:[{CJK}]|[^ \n\t\r{CJK}]+)[ \n\t\r]*"

# Cell contents that stand for "nothing" in exported spreadsheets.
EMPTY_WRAPPERS = ['[""]', "['']", "[]", '""', "''"]

# Questions that ask for a count or a full listing.
AGGREGATION_PATTERN = (
    r"(一共|总共|共有?|总计)[多少几个家条份]"
    r"|[多少几](个|家|只|条|份|种)"
    r"|列出所有|列举所有|所有的?\S+有哪些"
    r"|统计.{0,10}(数量|个数|多少|几个|几家)"
)

# Topic keywords of the three question sets, first matching topic wins.
TOPICS_STANDARDS = {
    "工艺参数": ["温度", "压力", "流量", "浓度", "转化率", "收率", "反应", "催化"],
    "安全规程": ["安全", "危险", "禁止", "警告", "防护", "事故", "应急", "泄漏"],
    "质量标准": ["指标", "标准", "规格", "限值", "合格", "检验", "测定", "分析"],
    "设备操作": ["操作", "启动", "停车", "维修", "检修", "设备", "仪表", "阀门"],
}
TOPICS_SEGMENTS = {
    "工艺参数": ["温度", "压力", "流量", "浓度", "氢油比", "空速", "转化率", "收率", "反应"],
    "安全规程": ["安全", "危险", "禁止", "警告", "防护", "事故", "应急", "泄漏", "不得", "不允许"],
    "质量标准": ["指标", "标准", "规格", "限值", "合格", "检验", "测定", "分析"],
    "设备操作": ["操作", "启动", "停车", "维修", "检修", "设备", "仪表", "阀门", "开工", "停工"],
}
TOPICS_PAGES = {
    "工艺参数": ["温度", "压力", "流量", "浓度", "密度", "参数", "操作条件"],
    "安全规程": ["安全", "危险", "防护", "应急", "泄漏", "火灾"],
    "质量标准": ["质量", "指标", "标准", "规格", "合格"],
    "设备操作": ["设备", "装置", "阀门", "泵", "换热器", "反应器"],
}
OTHER_TOPIC = "其他"

_BLANKS = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    """Trim blanks and line breaks on both sides."""
    return F.btrim(text, F.lit(_BLANKS))


def tokens(text: Column) -> Column:
    """Lower-cased words longer than one character; runs of CJK characters give their bigrams."""
    low = F.lower(text)
    words = F.filter(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda w: F.length(w) > 1)
    runs = F.filter(F.regexp_extract_all(low, F.lit(CJK_RUN), F.lit(0)), lambda r: F.length(r) > 1)
    bigrams = F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))),
        )
    )
    return F.when(low.rlike(CJK_RUN), F.concat(words, bigrams)).otherwise(words)


def units(text: Column) -> Column:
    """Words or single CJK characters with their trailing blanks."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def unit_count(text: Column) -> Column:
    """Length of a text in units, at least 1 for any row."""
    return F.greatest(F.regexp_count(text, F.lit(UNIT)), F.lit(1))


def detect_language(text: Column) -> Column:
    """``zh`` where CJK characters make up more than 0.3 of all word characters, else ``en``."""
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]"))
    word_chars = F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]"))
    return F.when((word_chars > 0) & (cjk / word_chars > ZH_SHARE), F.lit("zh")).otherwise(F.lit("en"))


def is_aggregation_query(text: Column) -> Column:
    return text.rlike("(?i)" + AGGREGATION_PATTERN)


def topic(text: Column, topics: dict[str, list[str]] = TOPICS_STANDARDS, other: str = OTHER_TOPIC) -> Column:
    """First topic with a keyword in the text."""
    out = None
    for name, words in topics.items():
        hit = text.rlike("|".join(words))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


def clean_value(value: Column) -> Column:
    """Trimmed cell text; NaN, empty text and the empty wrappers become NULL."""
    text = strip(value.cast("string"))
    return F.when((text == "") | (text == "NaN") | (text == "nan") | text.isin(EMPTY_WRAPPERS), None).otherwise(text)


def clean_latex(text: Column) -> Column:
    """Drop inline formulas and command prefixes, collapse runs of spaces, trim."""
    # The three patterns of the clean-up.
    no_formula = F.regexp_replace(text, r"\$[^$]+\$", "")
    no_command = F.regexp_replace(no_formula, r"\\[a-zA-Z]+[ \n\t\r\f]*\{?|\}", "")
    return strip(F.regexp_replace(no_command, r"  +", " "))


def split_entities(raw: Column) -> Column:
    """Trimmed entries of a comma / line separated list that are at least two characters long."""
    parts = F.transform(F.split(raw, r"[,，、\n]"), strip)
    return F.filter(parts, lambda e: F.length(e) >= 2)


def mark_headings(text: Column, max_length: int = 60) -> Column:
    """Prefix numbered one-line paragraphs with ``##``, ``###`` or ``####``."""
    # Numbering patterns of second, third and fourth level headings.
    h2 = rf"^\d{{1,2}}\s+[{CJK}A-Z(（]"
    h3 = rf"^\d{{1,2}}\.\d{{1,2}}\s+[{CJK}A-Z(（]"
    h4 = r"^\d{1,2}(?:\.\d+){2,}\s+\S"

    def mark(paragraph: Column) -> Column:
        s = strip(paragraph)
        one_line = (~F.contains(s, F.lit("\n"))) & (F.length(s) > 1) & (F.length(s) <= max_length)
        return (
            F.when(one_line & s.rlike(h4), F.concat(F.lit("#### "), s))
            .when(one_line & s.rlike(h3), F.concat(F.lit("### "), s))
            .when(one_line & s.rlike(h2), F.concat(F.lit("## "), s))
            .otherwise(paragraph)
        )

    return F.array_join(F.transform(F.split(text, "\n\n"), mark), "\n\n")


def paragraph_pieces(text: Column, size: int = 600) -> Column:
    """Newline paragraphs packed to at most ``size`` characters; longer paragraphs are cut hard."""
    paragraphs = F.filter(F.transform(F.split(text, "\n"), strip), lambda p: p != "")

    def cut(p: Column) -> Column:
        n = F.greatest(F.ceil(F.length(p) / F.lit(size)).cast("int"), F.lit(1))
        return F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.substr(p, i * size + 1, F.lit(size))
        )

    def add(acc: Column, p: Column) -> Column:
        buf = acc["buf"]
        fits = F.length(buf) + F.length(p) + 1 <= size
        pieces = cut(p)
        closed = F.when(buf == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(buf)))
        return F.when(
            fits,
            F.struct(
                acc["done"].alias("done"),
                F.when(buf == "", p).otherwise(F.concat(buf, F.lit("\n"), p)).alias("buf"),
            ),
        ).otherwise(
            F.struct(
                F.concat(closed, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("done"),
                F.element_at(pieces, -1).alias("buf"),
            )
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))
    packed = F.aggregate(
        paragraphs,
        start,
        add,
        lambda acc: F.when(acc["buf"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["buf"]))),
    )
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).when(
        F.length(text) <= size, F.array(text)
    ).otherwise(packed)


def set_f1(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct tokens as an F1 value in 0..1."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def token_f1(query: Column, text: Column) -> Column:
    """The built-in pair score: F1 of the token sets of a query and a text."""
    return set_f1(F.array_distinct(tokens(query)), F.array_distinct(tokens(text)))


def sampled_excerpt(text: Column, key: Column, seed: str = "42", size: int = 6000, snap: int = 200) -> Column:
    """Up to ``size`` characters; long texts from a seeded start, moved behind a near line break."""
    n = F.length(text)
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("bigint")
    start = F.pmod(draw, (n - size + 1).cast("bigint")).cast("int")
    at = F.instr(F.substr(text, start + 1, F.lit(snap)), "\n")
    begin = F.when(at > 0, start + at).otherwise(start)
    return F.when(n <= size * 1.5, F.substring(text, 1, size)).otherwise(F.substr(text, begin + 1, F.lit(size)))
