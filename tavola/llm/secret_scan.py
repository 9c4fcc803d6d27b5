"""Secret scan with a trigram inverted index; built-in functions only.

Every rule's regular expression gives a Boolean trigram query: trigrams that each of its
matches must hold, as an OR of ANDs over lower-case text.  The index posts (trigram, row)
for the trigrams that any rule asks for.  Counting a clause's trigrams by row intersects
the postings; rows that meet a clause are candidates of the rule, and only they are
verified with the expression.  A rule without a mandatory trigram scans every row.

Spans come from the texts between matches and the matches themselves: their lengths give
start and end in code points.  Whole texts are scanned.

Defined cases: a null text is empty and has no span; a row with a null id is found like any other;
rows that repeat an id are scanned each (a candidate row's id marks them all); input columns may have any names;
matches are leftmost and do not overlap within a rule, those shorter than the rule asks are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:  # the parser of Python's own regular expressions
    from re import _parser as parser
except ImportError:  # pragma: no cover - before Python 3.11
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """kind, expression (one that Java and Python read alike), and the least length of ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The fixed rules, in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that are long enough
)

#: More rules: public formats of credentials.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("urlauth", r"[a-z]{2,10}://[A-Za-z0-9._-]+:[^\x00-\x20@/]+@[A-Za-z0-9.-]+"),
)


def _literals(parsed) -> list[list[str]]:
    """Alternatives of a parsed expression, each the literal runs that a match must hold."""
    alternatives: list[list[str]] = [[""]]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            alternatives = [[*runs[:-1], runs[-1] + chr(value).lower()] for runs in alternatives]
            continue
        if name == "SUBPATTERN":
            inner = _literals(value[-1])
        elif name == "BRANCH":
            inner = [runs for branch in value[1] for runs in _literals(branch)]
        elif name == "MAX_REPEAT" and value[0] >= 1:
            inner = [[*runs, ""] for runs in _literals(value[2])]  # what follows may be another turn
        elif name == "IN" and len(value) <= 8 and all(str(kind) == "LITERAL" for kind, _ in value):
            inner = [[chr(c).lower()] for _, c in value]
        else:
            inner = [["", ""]]
        alternatives = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in alternatives for b in inner]
    return alternatives


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of trigrams, or None if some match needs none."""
    clauses = [frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)) for runs in _literals(parser.parse(pattern))]
    clauses = [c for c in clauses if not any(d < c for d in clauses)]  # a weaker clause makes a stronger one needless
    return None if not all(clauses) else sorted(set(clauses), key=sorted)


def postings(rows: DataFrame, trigrams: list[str], text: str, id: str) -> DataFrame:  # noqa: A002
    """The inverted index (trigram, id) for the trigrams asked for."""
    lower = F.lower(F.col(text))
    held = F.filter(F.array(*[F.when(F.contains(lower, F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return rows.select(F.col(id).alias("id"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(id, rules): the rows that meet a clause of each rule, by intersecting postings."""
    clauses = sorted({c for q in queries.values() for c in q}, key=sorted)
    numbers: dict[str, list[int]] = {}
    for k, clause in enumerate(clauses):
        for t in clause:
            numbers.setdefault(t, []).append(k)
    of_trigram = F.create_map(*[F.lit(x) for t, ks in sorted(numbers.items()) for x in (t, ks)])
    need = F.array(*[F.lit(len(c)) for c in clauses])
    rules = F.array(*[F.array(*[F.lit(kind) for kind, q in queries.items() if c in q]) for c in clauses])
    found = index.distinct().select("id", F.explode(of_trigram[F.col("trigram")]).alias("clause")).groupBy("id", "clause").agg(F.count("*").alias("n"))
    met = found.where(F.col("n") == need[F.col("clause")])
    return met.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set(rules[F.col("clause")]))).alias("rules"))


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<kind, start, end>> of the rule's matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    steps = F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("length")))
    steps = F.zip_with(steps, sized, lambda s, m: F.struct(s["gap"].alias("gap"), s["length"].alias("length"), F.char_length(m).alias("sized")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def step(acc, s):
        begin = acc["at"] + s["gap"]
        end = begin + s["length"]
        span = F.array(F.struct(F.lit(rule.kind).alias("kind"), begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.when(s["sized"] >= rule.least, span).otherwise(none)).alias("spans"))

    def walk(every):
        """The steps in about sqrt(n) turns of as many steps, so that appending copies short arrays only."""
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(every))).cast("int"))
        turns = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(every) / width).cast("int") - 1))

        def turn(done, k):
            begin = F.struct(F.element_at(done, -1)["at"].alias("at"), none.alias("spans"))
            return F.concat(done, F.array(F.aggregate(F.slice(every, k * width + 1, width), begin, step)))

        start = F.array(F.struct(F.lit(0).alias("at"), none.alias("spans")))
        return F.flatten(F.transform(F.aggregate(turns, start, turn), lambda t: t["spans"]))

    found = F.transform(F.array(steps), walk)[0]  # the matches are made once, and then have a name
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", id: str = "doc_id") -> DataFrame:  # noqa: A002
    """One row per document: doc_id, spans array<struct<kind, start, end>> by start, then by rule order."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q}
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    index = postings(rows.where("doc_id is not null"), sorted({t for q in asked.values() for c in q for t in c}), "text", "doc_id")
    rows = rows.join(candidates(index, asked), F.col("doc_id") == F.col("id"), "left") if asked else rows.withColumn("rules", F.array().cast("array<string>"))
    found = []

    def ranked(k: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))

    for k, rule in enumerate(rules):
        test = F.lit(True) if not queries[rule.kind] else F.col("doc_id").isNull() | F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
        none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
        ordered = F.transform(F.when(test, _spans(F.col("text"), rule)).otherwise(none), ranked(k))
        found.append(ordered)
    spans = F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", spans.alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

