"""Redaction of personal data: an ordered list of rules, each with its count.

Placeholders of earlier rules can feed later ones, so the order matters and a text is to be scrubbed once only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

# Fixed values: (count column, label, placeholder, pattern), in the order they are applied.
RULES = [
    ("n_id_card", "身份证号", "[身份证号]", r"(?U)(?<!\d)([1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx])(?!\d)"),
    ("n_mobile", "手机号", "[手机号]", r"(?U)(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)"),
    ("n_landline", "座机号", "[座机号]", r"(?U)(?<!\d)(0\d{2,3})[-\s\x1c-\x1f]?\d{7,8}(?!\d)"),
    ("n_email", "邮箱", "[邮箱]", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"),
    ("n_bank_card", "银行卡号", "[银行卡号]", r"(?U)(?<!\d)(\d{4})[\s\x1c-\x1f]?\d{4}[\s\x1c-\x1f]?\d{4}[\s\x1c-\x1f]?\d{2,7}(?!\d)"),
    ("n_qq", "QQ号", "[QQ号]", r"(?U)(?:QQ|qq)[：:][\s\x1c-\x1f]*\d{5,12}"),
    ("n_wechat", "微信号", "[微信号]", r"(?U)(?:微信|WeChat|wechat)[：:][\s\x1c-\x1f]*[a-zA-Z0-9_-]{5,20}"),
    ("n_ip", "IP地址", "[IP地址]", r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\b"),
    ("n_medical_no", "病历号", "[病历号]", r"(?U)(?:住院号|病历号|门诊号|就诊号|档案号|床号)[：:\s\x1c-\x1f]*(\d{4,20})"),
    ("n_patient", "姓名", "[患者姓名]", r"(?U)(?:患者|患儿|病人|产妇|孕妇|家属|监护人)[：:，,\s\x1c-\x1f]*([一-鿿]{2,4})"),
    ("n_doctor", "姓名", "[医生姓名]", r"([一-鿿]{2,4})(?:医生|主任|教授|博士|院长|科长|护士长|主治医师|副主任医师|主任医师)"),
    ("n_labelled", "姓名", "[姓名]", r"(?U)(?:姓名|名字)[：:][\s\x1c-\x1f]*([一-鿿]{2,4})"),
    ("n_partial", "姓名", "[姓名]", r"(?U)([一-鿿]{1,2})某[，,。.、\s\x1c-\x1f]"),
]
ADDRESS_LABEL, ADDRESS_PUT = "详细地址", "[详细地址]"
# An address has two components at least; it is redacted if it has three of the counted ones.
_PART = r"[一-鿿]{1,3}(?:省|市|区|县|镇|乡|村|路|街|道|号|栋|幢|楼|室|单元)"
ADDRESS = rf"{_PART}{_PART}(?:{_PART})*+"
ADDRESS_PART, ADDRESS_LEAST = "省|市|区|县|镇|路|街|道|号|栋|楼|室", 3

#: Forms of rules that find the same matches without scanning a long run again from each of its characters.
LINEAR = {"n_email": r"(?:(?<![a-zA-Z0-9_.+-])|\G)[a-zA-Z0-9_.+-]++@[a-zA-Z0-9-]++\.[a-zA-Z0-9-.]+"}
#: Pieces of which a match holds one; a text without any is not searched.
PIECES = {
    "n_email": ["@"],
    "n_qq": ["QQ", "qq"],
    "n_wechat": ["微信", "WeChat", "wechat"],
    "n_ip": ["."],
    "n_medical_no": ["号"],
    "n_patient": ["患者", "患儿", "病人", "产妇", "孕妇", "家属", "监护人"],
    "n_doctor": ["医生", "主任", "教授", "博士", "院长", "科长", "护士长", "医师"],
    "n_labelled": ["姓名", "名字"],
    "n_partial": ["某"],
}

COUNTS = [r[0] for r in RULES] + ["n_address"]


def _detailed(address: Column) -> Column:
    return F.regexp_count(address, F.lit(ADDRESS_PART)) >= ADDRESS_LEAST


def redact_addresses(c: Column) -> tuple[Column, Column]:
    """The text with detailed addresses redacted, and their number."""
    found = F.regexp_extract_all(c, F.lit(f"({ADDRESS})"), F.lit(1))
    put = F.concat(F.transform(found, lambda a: F.when(_detailed(a), F.lit(ADDRESS_PUT)).otherwise(a)), F.array(F.lit("")))
    between = F.split(c, ADDRESS, -1)
    text = F.array_join(F.flatten(F.zip_with(between, put, lambda a, b: F.array(a, b))), "")
    return F.when(F.size(found) > 0, text).otherwise(c), F.size(F.filter(found, _detailed))


def scrub(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``text`` redacted and a count column for each rule; each rule's text is evaluated once.

    A text that a rule leaves as it was has no match to count. Null stays null, with null counts.
    """
    own, was, now = [F.col(f"`{c}`") for c in df.columns if c != text], "__was", F.col(f"`{text}`")
    for name, _, put, pattern in RULES:
        pattern = LINEAR.get(name, pattern)
        replaced = F.regexp_replace(now, pattern, put)
        pieces = PIECES.get(name)
        if pieces:
            replaced = F.when(reduce(or_, (F.contains(now, F.lit(p)) for p in pieces)), replaced).otherwise(now)
        df = df.select(*own, now.alias(was), T.held(replaced).alias(text))
        count = F.when(now == F.col(was), F.lit(0)).otherwise(F.regexp_count(F.col(was), F.lit(pattern)))
        own.append(count.cast("long").alias(name))
        df = df.select(*own, now)
        own[-1] = F.col(name)
    redacted, n = redact_addresses(now)
    return df.select(*own, n.cast("long").alias("n_address"), T.held(redacted).alias(text))


def labels() -> list[tuple[str, list[str]]]:
    """Each label with its count columns; the name rules share one."""
    out: dict[str, list[str]] = {}
    for name, label, *_ in [*RULES, ("n_address", ADDRESS_LABEL)]:
        out.setdefault(label, []).append(name)
    return list(out.items())


def redaction_totals(scrubbed: DataFrame) -> DataFrame:
    """(label, total) of the labels that occur."""
    sums = scrubbed.agg(*(F.coalesce(F.sum(sum(F.col(c) for c in cs)), F.lit(0)).alias(f"s{i}") for i, (_, cs) in enumerate(labels())))
    rows = F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"s{i}").alias("total")) for i, (label, _) in enumerate(labels()))))
    return sums.select(rows.alias("r")).select("r.label", "r.total").where("total > 0")


def scrub_sql(source: str, text: str = "text") -> str:
    """CTEs ``r0`` .. for DuckDB over a relation with ``text``: lookarounds become captured neighbours, replaced twice; counts are of new placeholders."""
    ctes, last = [], source
    for i, (name, _, put, pattern) in enumerate(RULES):
        p = pattern.removeprefix("(?U)").replace(T.WS[1:-1], T.SQL_WS[1:-1]).replace("\\d", "\\p{Nd}").replace("[\\p{Nd}Xx]", "[\\p{Nd}Xx]")
        put_sql = put
        if "(?<!" in p:
            core = p.replace("(?<!\\p{Nd})", "").replace("(?!\\p{Nd})", "")
            core = core.replace("([", "(?:[").replace("(1", "(?:1").replace("(0\\", "(?:0\\").replace("(\\p", "(?:\\p")
            p, put_sql, times = f"(^|[^\\p{{Nd}}]){core}([^\\p{{Nd}}]|$)", f"\\1{put}\\2", 2
        elif "\\b" in p:
            core = p.replace("\\b", "")
            p, put_sql, times = f"(^|[^\\p{{L}}\\p{{N}}_]){core}([^\\p{{L}}\\p{{N}}_]|$)", f"\\1{put}\\2", 2
        else:
            times = 1
        expr = text
        for _ in range(times):
            expr = f"regexp_replace({expr}, '{p}', '{put_sql}', 'g')"
        n = f"CAST((length(x.{text}) - length(replace(x.{text}, '{put}', '')) - length(y.{text}) + length(replace(y.{text}, '{put}', ''))) / {len(put)} AS BIGINT)"
        ctes.append(f"q{i} AS (SELECT * REPLACE ({expr} AS {text}) FROM {last})")
        ctes.append(f"r{i} AS (SELECT x.*, {n} AS {name} FROM q{i} x JOIN {last} y USING (doc_id))")
        last = f"r{i}"
    return ",\n".join(ctes)
