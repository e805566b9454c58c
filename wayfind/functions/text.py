"""Term and token functions over text columns.

Terms are runs of Hangul syllables or of ASCII letters and digits. What other letters do (é, ß) follows from that: they
end a term and count as punctuation.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from wayfind.functions.batches import bound_batches

# Stop words, particles that follow nouns, verb endings, and terms with one canonical form.
STOP_WORDS = "그리고 그러나 하지만 또는 에서 으로 에게 이다 있다 없다 the a an of to is are and or"
PARTICLES = "은|는|이|가|을|를|에|의|와|과|도|로|으로|에서|에게|까지|부터|만"
LONG_PARTICLES = (
    "으로부터|로부터|에서부터|이라는|라는|에게서|으로서|으로써|이지만|지만|에서는|에게는|까지도|부터는"
    "|은|는|이|가|을|를|에|의|와|과|도|로|으로|에서|에게|까지|부터|만|이나|나|든지|처럼|보다|마다|조차|밖에"
)
VERB_ENDINGS = "합니다|입니다|했나요|하나요|인가요|는가|은가|나요|해줘|알려줘|보여줘|주세요|이야|야|임|중인|중"
SYNONYMS = {
    "클라이언트": "고객사", "client": "고객사", "고객": "고객사", "거래처": "고객사",
    "product": "제품", "프로덕트": "제품", "솔루션": "제품",
    "employee": "직원", "사원": "직원", "담당자": "직원", "엔지니어": "직원",
    "department": "부서", "팀": "부서", "project": "프로젝트", "contract": "계약",
    "ticket": "티켓", "문의": "티켓", "장애": "장애", "sales": "매출", "판매": "매출",
    "진행중": "in_progress", "진행": "in_progress", "완료": "completed", "대기": "on_hold",
    "해결": "resolved", "종료": "closed", "활성": "active",
}
SEED_STOP_WORDS = """
사용 사용중 사용하는 소속 담당 담당자 이끄는 맡은 팀장 부서장 제품 고객 고객사 직원 부서 프로젝트 계약 이슈 목록 현황 관련
관련된 누구 어디 무엇 얼마 가장 많은 적은 진행 중인 알려줘 보여줘 궁금해 엔지니어 지원
"""

#: White space as a regular-expression class body; Java's own \s has ASCII only.
WHITE = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# What a term and a seed term are made of stands in the patterns of content_terms and seed_terms.
HANGUL = "[가-힣]"
_TOKEN = f"[A-Za-z0-9]+|[^A-Za-z0-9_{WHITE}]"  # what est_tokens counts
#: Word boundaries for ASCII words, so that a Hangul neighbour is a boundary.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _words(text: str) -> Column:
    return F.array(*[F.lit(w) for w in text.split()])


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def est_tokens(text: Column) -> Column:
    """Hangul syllables, ASCII words and other visible characters; monotonic in length. Null counts as empty."""
    one_each = F.regexp_replace(_or_empty(text), f"([A-Za-z0-9])[A-Za-z0-9]*+[_{WHITE}]*+|[_{WHITE}]++", "$1")  # a character a token is left
    return F.length(one_each)


def est_cut(text: Column, most: Column) -> Column:
    """Length of the longest prefix of at most `most` tokens: it ends where the next token begins."""
    pieces = F.regexp_extract_all(text, F.lit(f"[_{WHITE}]*({_TOKEN})"), F.lit(0))  # a token with what stands before it
    before = F.length(F.array_join(F.slice(pieces, F.lit(1), most), ""))
    gap = F.length(F.regexp_extract(F.get(pieces, most), f"^[_{WHITE}]*", 0))
    return F.when(F.size(pieces) > most, before + gap).otherwise(F.length(text))


def content_terms(text: Column) -> Column:
    """Distinct terms in lower case without a trailing particle, two characters at least, no stop words.

    A few passes over the whole text, nothing word by word: a particle is cut where its run of Hangul ends.
    """
    low = F.lower(_or_empty(text))
    bare = F.when(low.rlike(HANGUL), F.regexp_replace(low, f"({PARTICLES})(?!{HANGUL})", " ")).otherwise(low)
    return F.array_except(F.regexp_extract_all(bare, F.lit(f"({HANGUL}{{2,}}|[a-z0-9]{{2,}})"), F.lit(1)), _words(STOP_WORDS))


def seed_terms(text: Column) -> Column:
    """Distinct terms that may name an entity: identifiers with their hyphens, Hangul words without particles or type nouns."""
    raw = F.regexp_extract_all(_or_empty(text), F.lit(f"([A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*|{HANGUL}{{2,}})"), F.lit(1))
    bare = F.transform(raw, lambda w: F.regexp_replace(w, f"({PARTICLES})$", ""))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= 2) & ~F.array_contains(_words(SEED_STOP_WORDS), w)))


def strip_tails(word: Column) -> Column:
    """A Hangul word of three syllables or more without its verb ending, then particle; left alone if under two remain."""
    long_hangul = f"^{HANGUL}{{3,}}$"
    once = F.when(word.rlike(long_hangul), F.regexp_replace(word, f"({VERB_ENDINGS})$", "")).otherwise(word)
    twice = F.when(once.rlike(long_hangul), F.regexp_replace(once, f"({LONG_PARTICLES})$", "")).otherwise(once)
    # Inside lambdas nothing is shared between branches, so other words leave after one test.
    return F.when(word.rlike(long_hangul), F.when(F.length(twice) >= 2, twice).otherwise(word)).otherwise(word)


def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


_nfkc.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}


#: Characters that are their own compatibility form and join with none before them, as a regular-expression class body.
STABLE = r"\u0000-\u009F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\uAC00-\uD7A3"


def fold(text: Column, nfkc: bool = True) -> Column:
    """Compatibility forms folded, lower case. Only texts with characters that may have such forms leave the JVM, in bounded
    batches. nfkc=False: none does, for text known to have no such forms."""
    if not nfkc:
        return F.lower(text)
    bound_batches(SparkSession.getActiveSession())
    return F.lower(F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(text.rlike(f"[^{STABLE}]"), text)), text))


def split_alnum(word: Column) -> Column:
    """product7x -> product, 7, x, product7x: for words with letters and digits, else nothing."""
    parts = F.regexp_extract_all(word, F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    mixed = word.rlike("[a-z]") & word.rlike("[0-9]") & (F.size(parts) > 1)
    return F.when(mixed, F.concat(parts, F.array(F.array_join(parts, "")))).otherwise(F.array().cast("array<string>"))


def adjacent(words: Column, most: int) -> Column:
    """Each word joined to the next, if together they have 2 to `most` characters."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.filter(pairs, lambda w: w.isNotNull() & F.length(w).between(2, most))


def normalize_tokens(text: Column, nfkc: bool = True) -> Column:
    """Distinct index tokens in order: bare terms, their synonyms and pieces; then joined neighbours."""
    folded = fold(_or_empty(text), nfkc)
    return normalize_folded(folded)


def normalize_folded(folded: Column) -> Column:
    """Texts without Hangul need no rule of word ends, and without mixed words or synonyms no rule a word at all."""
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])

    def forms(w: Column) -> Column:
        pieces = F.filter(split_alnum(w), lambda p: F.length(p) >= 2)
        return F.concat(F.array(w), F.filter(F.array(F.try_element_at(table, w)), lambda s: s.isNotNull()), pieces)

    special = "[a-z][0-9]|[0-9][a-z]|" + "|".join(w for w in SYNONYMS if w.isascii())
    plain = F.regexp_extract_all(folded, F.lit("([a-z0-9]{2,})"), F.lit(1))
    bare = F.transform(F.regexp_extract_all(folded, F.lit(f"({HANGUL}+|[a-z0-9]+)"), F.lit(1)), strip_tails)
    single = (
        F.when(folded.rlike(HANGUL), F.flatten(F.transform(F.filter(bare, lambda w: F.length(w) >= 2), forms)))
        .when(folded.rlike(special), F.flatten(F.transform(plain, lambda w: F.when(w.rlike(special), forms(w)).otherwise(F.array(w)))))
        .otherwise(plain)
    )
    alnum = F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), F.lit(1))
    hangul = F.transform(F.regexp_extract_all(folded, F.lit(f"({HANGUL}+)"), F.lit(1)), strip_tails)
    return F.array_distinct(F.concat(single, adjacent(alnum, 24), adjacent(hangul, 8)))


def index_text(text: Column, nfkc: bool = True) -> Column:
    return F.array_join(normalize_tokens(text, nfkc), " ")


def normalize_query(text: Column, nfkc: bool = True) -> Column:
    """struct<tokens, tsquery, stripped, synonyms, joined>: the tokens, the prefix query, and what the rules did."""
    folded = fold(_or_empty(text), nfkc)
    raw = F.regexp_extract_all(folded, F.lit(f"({HANGUL}+|[a-z0-9]+)"), F.lit(1))
    tokens = normalize_folded(folded)
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    changed = F.filter(raw, lambda w: strip_tails(w) != w)
    known = F.filter(raw, lambda w: F.try_element_at(table, strip_tails(w)).isNotNull())
    return F.struct(
        tokens.alias("tokens"),
        F.array_join(F.transform(tokens, lambda t: F.concat(t, F.lit(":*"))), " | ").alias("tsquery"),
        F.transform(changed, lambda w: F.concat(w, F.lit(" -> "), strip_tails(w))).alias("stripped"),
        F.transform(known, lambda w: F.concat(strip_tails(w), F.lit(" -> "), F.try_element_at(table, strip_tails(w)))).alias("synonyms"),
        F.array_except(F.filter(tokens, lambda t: t.rlike(f"^{HANGUL}+$")), raw).alias("joined"),
    )


def fnv1a(word: Column) -> Column:
    """FNV-1a of the UTF-16 units as an unsigned 32-bit number in a long; characters beyond the basic plane differ."""
    codes = F.transform(F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>")), lambda i: F.ascii(F.substring(word, i, F.lit(1))).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def content_hash(text: Column) -> Column:
    """16 hexadecimal digits of SHA-256, whatever the line ends."""
    return F.substring(F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256), 1, 16)


def contains_all(text: Column, words: Column) -> Column:
    """Does the text hold every one of the words, whatever their case?"""
    return F.forall(words, lambda w: F.contains(F.lower(text), F.lower(w)))
