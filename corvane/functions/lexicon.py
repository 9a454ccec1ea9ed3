"""The keyword lexicon and the fuzzy term match, as literals and equi-join keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that are no tokens.
STOP_WORDS = """
the and for with this that from have was were are has had not but you your our their they them will would can could should shall may might must
about into over under between after before during such only than very just also its been being does did what when where which who whom whose
there here these those each every both few more most other some all any once own same so then too really please thank thanks dear hi hello
regards etc na n/a page pages figure fig table section appendix index content subject document file files march april june july august monday
tuesday wednesday thursday friday saturday sunday january february september october november december
""".split()

# Keywords of each category with their weights.
_LEXICON: dict[str, list[tuple[str, float]]] = {
    "Education": [
        ("course", 1.2), ("lecture", 1.0), ("syllabus", 1.2), ("syllabi", 1.0), ("assignment", 1.0), ("homework", 1.0),
        ("exam", 1.0), ("quiz", 1.0), ("textbook", 1.0), ("notes", 1.0), ("handout", 1.0), ("lab", 1.0),
        ("thesis", 1.2), ("dissertation", 1.0), ("university", 1.5), ("college", 1.5), ("school", 1.0), ("study", 1.0),
        ("student", 1.2), ("professor", 1.0), ("degree", 1.2), ("semester", 1.0), ("grade", 1.0), ("transcript", 1.2),
        ("tutorial", 1.0), ("worksheet", 1.0), ("curriculum", 1.0), ("module", 1.0), ("lesson", 1.0),
        ("scholarship", 1.2), ("fellowship", 1.0),
    ],
    "Career": [
        ("resume", 1.5), ("cv", 1.4), ("curriculum", 1.0), ("job", 1.2), ("career", 1.0), ("offer letter", 1.3),
        ("interview", 1.0), ("salary", 1.0), ("payroll", 1.5), ("benefits", 1.0), ("onboarding", 1.0),
        ("training", 1.0), ("performance review", 1.2), ("appraisal", 1.0), ("offer", 1.0), ("employment", 1.2),
        ("employee", 1.0), ("referral", 1.0), ("portfolio", 1.0), ("nondisclosure", 1.2), ("nda", 1.0),
        ("professional", 1.0), ("recruit", 1.0), ("hire", 1.0),
    ],
    "Finance": [
        ("invoice", 1.5), ("receipt", 1.5), ("tax", 1.3), ("bank statement", 1.3), ("mortgage", 1.0), ("loan", 1.2),
        ("credit", 1.0), ("debit", 1.0), ("balance", 1.0), ("payment", 1.2), ("billing", 1.0), ("bill", 1.2),
        ("salary slip", 1.3), ("pay stub", 1.3), ("financial", 1.2), ("finance", 1.0), ("budget", 1.0),
        ("investment", 1.2), ("stock", 1.0), ("shares", 1.0), ("mutual fund", 1.2), ("insurance", 1.2),
        ("premium", 1.0), ("return filing", 1.2), ("gst", 1.2), ("vat", 1.0), ("income", 1.0), ("expense", 1.2),
        ("transaction", 1.0), ("interest", 1.0), ("reimbursement", 1.2), ("claim", 1.0),
    ],
    "Identity": [
        ("passport", 1.5), ("aadhaar", 1.5), ("pan card", 1.5), ("license", 1.3), ("driver", 1.0), ("voter", 1.0),
        ("visa", 1.3), ("certificate", 1.2), ("birth", 1.0), ("citizenship", 1.0), ("national identity", 1.3),
        ("identity", 1.0), ("identification", 1.0), ("ration card", 1.3), ("social security", 1.3), ("abn", 1.3),
        ("tfn", 1.3), ("sin", 1.3),
    ],
    "Photos": [],
    "Uncategorized": [],
}
CATEGORIES = list(_LEXICON)
MAX_SUFFIX = 3

#: (category order, category, term order, term, weight)
LEXICON = [(c, name, t, term, weight) for c, (name, words) in enumerate(_LEXICON.items()) for t, (term, weight) in enumerate(words)]


def lexicon_frame(spark: SparkSession) -> DataFrame:
    """(cat_ord, category, term_ord, term, weight): about a hundred rows."""
    return spark.createDataFrame(LEXICON, "cat_ord int, category string, term_ord int, term string, weight double")


def category_by_name(spark: SparkSession, name: str) -> DataFrame:
    """The category of a name, whatever its case."""
    return spark.createDataFrame([(i, c) for i, c in enumerate(CATEGORIES)], "cat_ord int, category string").where(F.lower("category") == name.lower())


def categories_of(names: DataFrame, name: str) -> DataFrame:
    """names with the category of each name, whatever its case; null for other names. The lexicon's few categories are sent to all tasks."""
    known = names.sparkSession.createDataFrame([(c.lower(), c) for c in CATEGORIES], "_lower string, category string")
    return names.join(F.broadcast(known), F.lower(name) == F.col("_lower"), "left").drop("_lower")


def term_matches(term: Column, token: Column) -> Column:
    """Equal, or one is the other with one to three more characters at its end."""
    more = F.length(token) - F.length(term)
    return (term == token) | (more.between(1, MAX_SUFFIX) & F.startswith(token, term)) | (more.between(-MAX_SUFFIX, -1) & F.startswith(term, token))


def shortened(text: Column, least: int) -> Column:
    """Array of structs (drop, key): text without its last ``least``..3 characters, never empty."""
    cut = F.transform(F.sequence(F.lit(least), F.lit(MAX_SUFFIX)), lambda d: F.struct(d.alias("drop"), F.substring(text, F.lit(1), F.length(text) - d).alias("key")))
    return F.filter(cut, lambda x: F.length(x["key"]) > 0)


def may_match(gram: Column) -> Column:
    """Whether a gram's first letters are those of a term: true for every gram that is a prefix of one, or has one as its prefix."""
    terms = {t for *_, t, _ in LEXICON}
    first = lambda n: F.substring(gram, 1, n)
    return first(4).isin(sorted({t[:n] for t in terms for n in range(1, 5)})) | first(3).isin(sorted(t for t in terms if len(t) == 3)) | first(2).isin(sorted(t for t in terms if len(t) == 2))


#: Tokens of a lower-cased text, as tokens() parts them.
TOKEN = re.compile(r"[a-z0-9+.#-]{2,}")
REMEMBERED = 1 << 18


class TermMatcher(dict):
    """Numbers of the LEXICON's entries that a gram matches, for use on executors; those asked for are remembered."""

    def __init__(self):
        super().__init__()
        self.stop = frozenset(STOP_WORDS)
        self.whole: dict[str, list[int]] = {}
        self.cut: dict[str, list[int]] = {}
        for n, (*_, term, _weight) in enumerate(LEXICON):
            self.whole.setdefault(term, []).append(n)
            for less in range(1, min(MAX_SUFFIX, len(term) - 1) + 1):
                self.cut.setdefault(term[:-less], []).append(n)
        #: first words of terms of two words: no other pair of tokens matches what its first token doesn't
        self.firsts = frozenset(t.split(" ")[0] for t in self.whole if " " in t)

    def __missing__(self, gram: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = set(self.cut.get(gram, ()))
        for more in range(min(MAX_SUFFIX, len(gram) - 1) + 1):
            found.update(self.whole.get(gram[: len(gram) - more], ()))
        self[gram] = out = tuple(sorted(found))
        return out

    def tokens(self, lowered: str) -> list[str]:
        return [t for t in TOKEN.findall(lowered) if t not in self.stop]

    def hits(self, lowered: str) -> list[int]:
        """Entries that the tokens of a lower-cased text, or neighbours among them, match."""
        toks = self.tokens(lowered)
        distinct = set(toks)
        found = {n for t in distinct for n in self[t]}
        if not self.firsts.isdisjoint(distinct):
            for a, b in zip(toks, toks[1:]):
                if a in self.firsts:
                    found.update(self[f"{a} {b}"])
        return sorted(found)


def match_terms(grams: DataFrame, gram: str = "gram") -> DataFrame:
    """grams joined with the lexicon where the term matches: two equi-joins in one, on shortened forms.

    A gram is longer than its term by 0 to 3: a shortened form of it is the term. It is shorter by 1 to
    3: it is a shortened form of the term. Either way one is a prefix of the other, so grams that share no
    first letters with a term are left out before. The lexicon is a constant of this module, so it is broadcast.
    """
    grams = grams.where(may_match(F.col(gram)))
    lexicon = lexicon_frame(grams.sparkSession)
    full = lexicon.withColumn("lookup", F.col("term")).withColumn("short", F.lit(False))
    short = lexicon.withColumn("x", F.explode(shortened(F.col("term"), 1))).withColumn("lookup", F.col("x.key")).withColumn("short", F.lit(True)).drop("x")
    keys = grams.withColumn("k", F.explode(shortened(F.col(gram), 0)))
    joined = keys.join(F.broadcast(full.unionByName(short)), F.col("k.key") == F.col("lookup"))
    return joined.where(~F.col("short") | (F.col("k.drop") == 0)).drop("k", "lookup", "short")
