"""Text cleaning steps and small text transforms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T

WS = T.WS

# Patterns of the cleaning steps, in their order.
TAG = r"<[^>]+>"
ENTITY = r"(?U)&[a-zA-Z]+;|&#\d+;"
URL = rf"(?U)https?://[^{WS[1:-1]}<>\"]+|www\.[^{WS[1:-1]}<>\"]+"
NAVIGATION = rf"(?Uiud)(?:首页|上一页|下一页|末页|返回|返回列表|更多|查看全部|版权所有| All Rights Reserved|Copyright{WS}*©?{WS}*\d*)[^\n]*"
COOKIE = r"(?iud)本网站使用.*?cookie|我们使用.*?cookie|继续浏览.*?同意"
NEWLINES = r"\n{3,}"
SPACES = r"[ \t]{4,}"


def clean(c: Column) -> Column:
    """Tags and entities out, URLs masked, navigation and cookie phrases out, white space and one pair of quotes trimmed, empty lines dropped."""
    rest = F.substring_index(c, ">", -1)  # no tag ends here, so it is not searched from each of its open brackets
    c = F.concat(F.regexp_replace(F.substring(c, F.lit(1), F.length(c) - F.length(rest)), TAG, ""), rest)
    for pattern, put in ((ENTITY, ""), (URL, "[URL]"), (NAVIGATION, ""), (COOKIE, ""), (NEWLINES, "\n\n"), (SPACES, "  ")):
        c = F.regexp_replace(c, pattern, put)
    c = F.regexp_replace(T.strip(c), r'\A"', "")
    c = F.regexp_replace(T.strip(c), r'"\z', "")
    lines = F.filter(F.transform(F.split(c, "\n", -1), T.strip), lambda line: line != "")
    return T.strip(F.array_join(lines, "\n"))


# Character classes of the CJK decode cleanup.
CJK = "一-鿿㐀-䶿豈-﫿"
CLOSING = "，。！？；：、）】」』"
OPENING = "（【「『"


def join_cjk(c: Column) -> Column:
    """Removes the blanks that decoding leaves between CJK characters and around their punctuation."""
    c = F.regexp_replace(c, rf"(?U)(?<=[{CJK}]){WS}+(?=[{CJK}])", "")
    c = F.regexp_replace(c, rf"(?U)(?<!{WS}){WS}++([{CLOSING}])", "$1")
    c = F.regexp_replace(c, rf"(?U)([{OPENING}]){WS}+", "$1")
    return T.strip(F.regexp_replace(c, rf"(?U){WS}{{2,}}", " "))


def answer_of(c: Column) -> Column:
    """What follows the last answer mark, without a leading question line."""
    c = F.regexp_replace(c, rf"(?Us)\A.*答{WS}*[：:]{WS}*", "")
    return T.strip(F.regexp_replace(c, r"(?d)\A问[：:].*?(?=\n|\z)", ""))


def strip_numbering(c: Column) -> Column:
    """A list item's number or bullet off its front: Arabic, then Chinese numerals, then bullets."""
    for pattern in (rf"(?U)\A\d+[.)）、]{WS}*", rf"(?U)\A[一二三四五六七八九十]+[、.)]{WS}*", rf"(?U)\A[•\-*]{WS}*"):
        c = F.regexp_replace(c, pattern, "")
    return T.strip(c)


def strip_quotes(c: Column) -> Column:
    """Any of the quote, the apostrophe off both ends."""
    return F.btrim(c, F.lit("\"'"))


def prompt_line(c: Column, least: int = 5) -> Column:
    """A generated prompt line made clean; null if it is shorter than ``least`` before or after its quotes go."""
    bare = strip_numbering(T.strip(c))
    out = T.strip(strip_quotes(bare))
    return F.when((F.length(bare) >= least) & (F.length(out) >= least), out)


def preview(c: Column, n: int = 150) -> Column:
    """The first characters on one line, with dots if there are more."""
    return F.concat(F.translate(F.substring(c, 1, n), "\n", " "), F.when(F.length(c) > n, F.lit("...")).otherwise(F.lit("")))


def thinking_answer(reasoning: Column, content: Column) -> Column:
    """A thinking block and the answer after it; a missing part is left out."""
    block = F.when(T.truthy(reasoning).isNotNull(), F.concat(F.lit("<thinking>\n"), reasoning, F.lit("\n</thinking>")))
    return F.concat_ws("\n\n", block, T.truthy(content))


def valid_thinking(c: Column, least: int = 20) -> Column:
    """Starts with a thinking block whose body and whose tail both have ``least`` characters."""
    close = F.locate("</thinking>", c)
    body = T.strip(F.substring(c, F.lit(11), F.greatest(close - 11, F.lit(0))))
    tail = T.strip(F.substring(c, close + 11, F.length(c)))
    return F.startswith(c, F.lit("<thinking>")) & (close > 0) & (F.length(body) >= least) & (F.length(tail) >= least)


def valid_pair(reasoning: Column, content: Column) -> Column:
    """Reasoning of 30 and content of 20 characters at least."""
    return (F.length(T.strip(F.coalesce(reasoning, F.lit("")))) >= 30) & (F.length(T.strip(F.coalesce(content, F.lit("")))) >= 20)


def keyword_pattern(keywords: list[str]) -> str:
    """One pattern for any of the keywords; the first in the list wins at a place, letters count alike in both cases."""
    return "(?iu)" + "|".join(rf"\Q{k}\E" for k in keywords)


def text_or(text: Column, content: Column) -> Column:
    """The text, or the content where the text is empty or missing."""
    return F.coalesce(T.truthy(text), content, F.lit(""))


def has_keywords(c: Column, keywords: list[str], least: int = 2) -> Column:
    return F.regexp_count(c, F.lit(keyword_pattern(keywords))) >= least


def clean_sql(expr: str) -> str:
    """The cleaning steps for DuckDB."""
    ws = T.SQL_WS[1:-1]
    steps = [
        ("<[^>]+>", ""), (r"&[a-zA-Z]+;|&#\p{Nd}+;", ""), (rf'https?://[^{ws}<>"]+|www\.[^{ws}<>"]+', "[URL]"),
        (rf"(?i)(?:首页|上一页|下一页|末页|返回|返回列表|更多|查看全部|版权所有| All Rights Reserved|Copyright[{ws}]*©?[{ws}]*\p{{Nd}}*)[^\n]*", ""),
        ("(?i)本网站使用.*?cookie|我们使用.*?cookie|继续浏览.*?同意", ""), (r"\n{3,}", "\n\n"), (r"[ \t]{4,}", "  "),
    ]
    for pattern, put in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{put}', 'g')"
    expr = f"regexp_replace({T.sql_strip(expr)}, '^\"', '')"
    expr = f"regexp_replace({T.sql_strip(expr)}, '\"$', '')"
    lines = f"list_filter(list_transform(string_split({expr}, chr(10)), lambda x: {T.sql_strip('x')}), lambda x: x <> '')"
    return T.sql_strip(f"array_to_string({lines}, chr(10))")
