"""Cleaning, redaction, quality and deduplication rules on hand-written rows, against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import clean, dedup, quality, scrub


def column(spark, values, c):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.o for r in rows.select("i", c(F.col("t")).alias("o")).orderBy("i").collect()]


ODD = ["", " ", "a", "　a ", "\x1ca\x1f", "\x85 a  ", "a b", "﻿a", "\t\n a \r\n"]


def test_strip_is_pythons(spark):
    assert column(spark, ODD, T.strip) == [x.strip() for x in ODD]


DIRTY = [
    '"quoted"', '""twice""', "a&nbsp;b &#12; &#x1F; c", "see https://x.org/a?b=1<br>and www.q.de　end", "x\n\n\n\ny    z\t\t\t\tw", "<p\nclass=x>t</p>", "首页 导航\n正文", "正文 更多>>\n尾",
    "all All Rights Reserved 2020\nnext", "copyright © 2021 me\nnext", "我们使用\rcookie ok", "我们使用 x cookie 继续浏览 y 同意 z", "我们使用 a\ncookie", "　 a   b \n\n \x1c \nc",
]


def python_clean(t):
    for p, r, f in [
        (r"<[^>]+>", "", 0), (r"&[a-zA-Z]+;|&#\d+;", "", 0), (r"https?://[^\s<>\"]+|www\.[^\s<>\"]+", "[URL]", 0),
        (r"(?:首页|上一页|下一页|末页|返回|返回列表|更多|查看全部|版权所有| All Rights Reserved|Copyright\s*©?\s*\d*)[^\n]*", "", re.I),
        (r"本网站使用.*?cookie|我们使用.*?cookie|继续浏览.*?同意", "", re.I), (r"\n{3,}", "\n\n", 0), (r"[ \t]{4,}", "  ", 0),
    ]:
        t = re.sub(p, r, t, flags=f)
    t = t.strip().removeprefix('"').strip()
    t = t.removesuffix('"')
    return "\n".join(x for x in (line.strip() for line in t.split("\n")) if x).strip()


def test_clean(spark):
    assert column(spark, DIRTY, clean.clean) == [python_clean(t) for t in DIRTY]


PRIVATE = [
    "11010519491231002X x", "id 110105194912310021", "110105194913310021", "13812345678", "a13812345678b", "138123456789", "010-12345678 0755 1234567", "１３８12345678", "a.b+c@d-e.com. x@y",
    "6222 0212 3456 7890", "62220212345678901234", "QQ：12345678 qq: 123", "微信：abc_12 WeChat:ab", "1.2.3.4 256.1.1.1 中1.2.3.4", "病历号：123456 床号 12", "患者张三，男", "王小明主任说", "姓名：李四",
    "张某，李某。", "北京市海淀区中关村路", "北京市海淀区", "某乡某村某幢", "上海市徐汇区天平路 和 杭州市西湖区", "",
]


def python_scrub(t):
    counts = {}
    for name, _, put, pattern in scrub.RULES:
        p = re.compile(pattern.removeprefix("(?U)").replace(r"\s\x1c-\x1f", r"\s"))
        counts[name] = len(p.findall(t))
        t = p.sub(put, t)
    n = 0

    def address(m):
        nonlocal n
        if len(re.findall(scrub.ADDRESS_PART, m[0])) < 3:
            return m[0]
        n += 1
        return scrub.ADDRESS_PUT

    t = re.sub(scrub.ADDRESS, address, t)
    return t, counts | {"n_address": n}


def test_scrub(spark):
    found = scrub.scrub(spark.createDataFrame(list(enumerate(PRIVATE)), "i int, text string")).orderBy("i").collect()
    for r, t in zip(found, PRIVATE, strict=True):
        want, counts = python_scrub(t)
        assert r.text == want and {c: r[c] for c in scrub.COUNTS} == counts, t
    totals = {r.label: r.total for r in scrub.redaction_totals(scrub.scrub(spark.createDataFrame(list(enumerate(PRIVATE)), "i int, text string"))).collect()}
    assert totals["姓名"] == sum(sum(python_scrub(t)[1][c] for c in ("n_patient", "n_doctor", "n_labelled", "n_partial")) for t in PRIVATE)


OK = dict(lang_score=0.9, perplexity=100.0, char_rep_ratio=0.1, word_rep_ratio=0.1, special_char_ratio=0.1, alnum_ratio=0.8, flagged_words_ratio=0.0)


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, "passed"), ({"text": "x" * 49}, "too_short"), ({"text": None}, "too_short"), ({"text": "x" * 50_001}, "too_long"), ({"text": "x" * 50_000}, "passed"), ({"lang_score": 0.5}, "passed"),
        ({"lang_score": 0.49}, "low_lang_score"), ({"lang_score": None}, "low_lang_score"), ({"perplexity": 10.0}, "passed"), ({"perplexity": 5000.0}, "passed"), ({"perplexity": 9.9}, "bad_perplexity"),
        ({"perplexity": None}, "bad_perplexity"), ({"char_rep_ratio": 0.3}, "passed"), ({"char_rep_ratio": 0.31}, "high_char_rep"), ({"word_rep_ratio": 0.51}, "high_word_rep"), ({"word_rep_ratio": None}, "passed"),
        ({"special_char_ratio": 0.41}, "high_special_chars"), ({"alnum_ratio": None}, "low_alnum"), ({"flagged_words_ratio": 0.011}, "high_flagged"), ({"lang_score": 0.1, "alnum_ratio": 0.1}, "low_lang_score"),
    ],
)
def test_quality_reason(spark, change, reason):
    row = {"text": "x" * 60} | OK | change
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if k == 'text' else 'double'}" for k in row))
    assert df.select(quality.reason().alias("r")).first().r == reason


def test_fingerprint_and_status(spark):
    base = "abc" * 70
    texts = ["", "a", "ab", "abc", base, base + "tail", base, "bca" * 70, "ab", "x" * 300, "x" * 200 + "y", "x" * 200 + "y"]

    def fp(t):
        head = t[:200]
        grams = "|".join(sorted({head[i : i + 3] for i in range(len(head) - 2)})) if len(head) >= 3 else head
        return hashlib.md5(grams.encode()).hexdigest()

    assert column(spark, texts, dedup.fingerprint) == [fp(t) for t in texts]
    exact, near, want = set(), set(), []
    for t in texts:
        if t in exact:
            want.append("exact_dup")
        elif fp(t) in near:
            want.append("near_dup")
        else:
            exact.add(t)
            near.add(fp(t))
            want.append("unique")
    got = dedup.dedup_status(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.status for r in got] == want


def test_lines_and_thinking(spark):
    lines = ["1. abcdef", "12）'quoted'", "三、项目一二三", "• point here", "-  - x", "1.2.3 abc", "ab", "'abc'", "  　spaced out "]

    def python_line(t):
        t = t.strip()
        for p in (r"^[\d]+[.)）、]\s*", r"^[一二三四五六七八九十]+[、.)]\s*", r"^[•\-\*]\s*"):
            t = re.sub(p, "", t)
        t = t.strip()
        out = t.strip("\"'").strip()
        return out if len(t) >= 5 and len(out) >= 5 else None

    assert column(spark, lines, clean.prompt_line) == [python_line(t) for t in lines]
    body, tail = "b" * 20, "t" * 20
    blocks = [f"<thinking>{body}</thinking>{tail}", f" <thinking>{body}</thinking>{tail}", f"<thinking>{body[1:]} </thinking>{tail}", f"<thinking>{body}</thinking>{tail[1:]}", f"<thinking>{body}", ""]
    assert column(spark, blocks, clean.valid_thinking) == [True, False, False, False, False, False]


def test_keywords(spark):
    words = ["obstructive sleep", "osa", "C++", "K-complex"]
    texts = ["Obstructive sleep OSA", "nosal", "c++ c++", "K-COMPLEX and k-complex", ""]
    pattern = re.compile("|".join(map(re.escape, words)), re.I)
    assert column(spark, texts, lambda c: clean.has_keywords(c, words)) == [len(pattern.findall(t)) >= 2 for t in texts]
