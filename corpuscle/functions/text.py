"""Column functions on text: tokens, counts, language, intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-鿿]"
#: Search tokens: a CJK character, an identifier, or a run of digits; case-sensitive.
SEARCH_TOKEN = r"[一-鿿]|[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+"
#: Counting units: a CJK character, an ASCII word, or one punctuation character.
UNIT_TOKEN = r"[一-鿿]|[A-Za-z0-9_]+|[^\s\p{Z}\p{L}\p{N}_]"
COUNT_TOKEN = r"[A-Za-z0-9_]+|[^\s\p{Z}\p{L}\p{N}_]"

# Wordings that ask about a document as a whole.
GLOBAL_INTENT = (
    r"总结|概述|摘要|概括|归纳|综述",
    r"主要(?:内容|观点|结论|工作|贡献|发现|讲|说)",
    r"贡献|创新(?:点|性)?|亮点|价值",
    r"讲了什么|说了什么|写的什么|内容是|讲的啥|说的啥",
    r"提出(?:了)?(?:什么|啥|哪些)?(?:方法|方案|框架|模型|算法|贡献|创新)",
    r"(?:方法|方案|框架|模型|算法|结论|思路)(?:是|为)(?:什么|啥)",
    r"有(?:什么|啥)(?:结论|贡献|创新|方法)",
    r"整体|全文|通篇|大致",
    r"\bsummar(?:y|ize|ise|izing|ising)\b",
    r"\boverview\b|\babstract\b|\bgist\b|\btl;?dr\b",
    r"\bmain\s+(?:idea|point|contribution|finding|takeaway|result|method)",
    r"\bcontribut(?:ion|e|es)\b|\bnovelt(?:y|ies)\b",
    r"\bwhat\s+(?:is|are|does)\b[^?]*\b(?:paper|document|article|file)\b",
    r"\bwhat\s+[a-z]+\s+(?:does|do|is|are|did)\b[^?]*\b(?:paper|document|article|report)\b",
    r"\bwhat\b[^?]*\babout\b",
    r"\btell\s+me\s+about\b",
    r"\bexplain\b[^?]*\b(?:paper|document|article|report)\b",
    r"\b(?:propose|present|introduce)s?\b[^?]*\b(?:method|approach|framework|model)\b",
    r"\bin\s+general\b|\boverall\b",
)
# Wordings that refer to the document at hand.
DOCUMENT_REFERENCE = (
    r"这(?:篇|份|个|本)|那(?:篇|份|个|本)|本(?:篇|文|文档|知识库)|该(?:篇|文|文档|知识库)|此(?:篇|文|文档)",
    r"论文|文献|文章|文档|资料|知识库|报告|材料",
    r"\b(?:this|these|the|that)\s+(?:paper|document|article|file|report|pdf)\b",
    r"\b(?:here|above|below)\b",
)
CONTENT_ANCHOR = r"[A-Za-z]{2,}|\p{Nd}{2,}"


def search_tokens(text: Column) -> Column:
    """Tokens of a text; a text without any is the single token ``_``."""
    t = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SEARCH_TOKEN), F.lit(0))
    return F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("_")))


def token_count(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(CJK)) + F.regexp_count(t, F.lit(COUNT_TOKEN))


def collapse(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def language(text: Column) -> Column:
    n = F.char_length(text)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "other")
        .when(F.regexp_count(text, F.lit(CJK)) / n >= 0.2, "zh")
        .when(F.regexp_count(text, F.lit("[A-Za-z]")) / n >= 0.5, "en")
        .otherwise("other")
    )


def language_threshold(lang: Column) -> Column:
    return F.when(lang == "zh", 0.65).when(lang == "en", 0.55).otherwise(0.6)


def intent(query: Column) -> Column:
    """global: asks about the whole document; else local."""
    q = collapse(F.coalesce(query, F.lit("")))
    wanted = q.rlike("(?i)" + "|".join(GLOBAL_INTENT))
    refers = q.rlike("(?i)" + "|".join(DOCUMENT_REFERENCE))
    return F.when(wanted & (refers | ~q.rlike(CONTENT_ANCHOR)), "global").otherwise("local")
