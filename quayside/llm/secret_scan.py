"""Secret scanning over a trigram inverted index, with DataFrame functions alone.

Each rule's regular expression is analysed into a Boolean trigram query: an AND of clauses, each an OR of strings, each
the AND of its trigrams. The index has a posting (trigram, document) for the trigrams that some rule names, over
lower-cased text. Postings are intersected per document; documents that satisfy a rule's query are its candidates, and
the regular expression verifies them. A rule without a mandatory trigram scans every document.

A posting list is never gathered: intersection groups by document, so a trigram that all documents hold does not make
a hot task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import cut, drop_cut, fresh_names

#: Marks the spans of a match in a copy of the text; its own occurrences are replaced by STAND_IN first.
MARK, STAND_IN = "﷐", "﷑"


@dataclass(frozen=True)
class Rule:
    """``least``: characters that group ``group`` must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # as [0-9a-f]+ of 24 characters or more: runs are maximal either way
)
#: Public formats of keys, beside the base kinds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES

#: Beyond so many strings a set is given up for what is mandatory in it.
MOST_STRINGS = 40


def trigram_query(pattern: str) -> list[list[str]]:
    """Clauses of the query: in each, one string (lower case, 3 characters or more) occurs in every match's text."""
    clauses: list[list[str]] = []

    def flush(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            clauses.append(sorted({s.lower() for s in strings}))

    def exact(nodes) -> set[str] | None:
        """All strings of a sub-pattern, or None if there are many."""
        found = {""}
        for op, arg in nodes:
            if op is sre.LITERAL:
                own = {chr(arg)}
            elif op is sre.IN:
                own = set()
                for kind, x in arg:
                    if kind is sre.LITERAL:
                        own.add(chr(x))
                    elif kind is sre.RANGE and x[1] - x[0] < 8:
                        own.update(map(chr, range(x[0], x[1] + 1)))
                    else:
                        return None
            elif op is sre.SUBPATTERN:
                own = exact(arg[3])
            elif op is sre.BRANCH:
                own = set()
                for branch in arg[1]:
                    one = exact(branch)
                    if one is None:
                        return None
                    own |= one
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
                one = exact(arg[2])
                if one is None:
                    return None
                own = set()
                for n in range(arg[0], arg[1] + 1):
                    part = {""}
                    for _ in range(n):
                        part = {a + b for a in part for b in one}
                        if len(part) > MOST_STRINGS:
                            return None
                    own |= part
            elif op is sre.AT:
                own = {""}
            else:
                return None
            if own is None:
                return None
            found = {a + b for a in found for b in own}
            if len(found) > MOST_STRINGS:
                return None
        return found

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            own = exact([node])
            if own is not None and len(run) * len(own) <= MOST_STRINGS:
                run = {a + b for a in run for b in own}
                continue
            flush(run)
            run = own if own is not None else {""}
            op, arg = node
            if own is None and op is sre.SUBPATTERN:
                walk(arg[3])
            elif own is None and op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        flush(run)

    walk(parser.parse(pattern))
    return clauses


def _row_key(names: list[str]) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text), F.length(text)]
    return [p.alias(n) for p, n in zip(parts, names)]


#: The row key of postings: id, hash and length of the text.
DOC = ["id", "hash", "len"]


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[dict[str, list[list[str]]], DataFrame]:
    """The rules' queries, and the written postings: gram, and the document as id, hash, len."""
    plans = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({s[i : i + 3] for q in plans.values() for c in q for s in c for i in range(len(s) - 2)})
    low = docs.select(*_row_key(DOC), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(F.col("low"), g)) if grams else F.array().cast("array<string>")
    return plans, cut(low.select(*DOC, F.explode_outer(held).alias("gram")).filter("gram is not null"), "postings")


def candidates(plans: dict[str, list[list[str]]], postings: DataFrame) -> DataFrame:
    """Documents (id, hash, len) with ``rules``: the kinds whose trigram query they satisfy."""
    spark = postings.sparkSession
    rows = []
    for kind, clauses in plans.items():
        for c, strings in enumerate(clauses):
            for a, s in enumerate(strings):
                own = sorted({s[i : i + 3] for i in range(len(s) - 2)})
                rows += [(g, kind, c, len(clauses), a, 1 << i, (1 << len(own)) - 1) for i, g in enumerate(own)]
    schema = "gram string, kind string, clause int, clauses int, alt int, bit long, full long"
    wanted = F.broadcast(spark.createDataFrame(rows, schema))  # as many rows as the rules have trigrams
    strings = postings.join(wanted, "gram").groupBy(*DOC, "kind", "clauses", "clause", "alt", "full").agg(F.bit_or("bit").alias("bits"))
    clauses = strings.filter("bits = full").groupBy(*DOC, "kind", "clauses").agg(F.count_distinct("clause").alias("n"))
    return clauses.filter("n = clauses").groupBy(*DOC).agg(F.collect_set("kind").alias("rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches that pass, as (start, order, end, kind) in code points."""
    parts = F.split(F.regexp_replace(text, rule.pattern, f"{MARK}$0{MARK}"), MARK)
    sizes = F.transform(parts, lambda p: F.length(p))
    odd = F.when(F.size(parts) > 2, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    if rule.group:
        passes = lambda i: F.length(F.regexp_extract(F.element_at(parts, i + 1), rule.pattern, rule.group)) >= rule.least
    else:
        passes = lambda i: F.element_at(sizes, i + 1) >= rule.least

    def span(i: Column) -> Column:
        start = F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)
        return F.struct(start.alias("start"), F.lit(order).alias("order"), (start + F.element_at(sizes, i + 1)).alias("end"), F.lit(rule.kind).alias("kind"))

    return F.transform(F.filter(odd, passes), span)


SPAN = "array<struct<start:int,order:int,end:int,kind:string>>"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``spans``: array of (start, order, end, kind), by start and then by the rules' order, in code points.

    A null or empty text has no spans. Rows are told apart by id and text; repeated rows get equal spans, also with a
    null id. A column named spans is replaced.
    """
    docs = docs.drop("spans")
    plans, postings = build_index(docs, rules)
    *names, kinds = fresh_names(docs, *DOC, "rules")
    found = cut(candidates(plans, postings).select(*[F.col(c).alias(n) for c, n in zip([*DOC, "rules"], [*names, kinds])]), "candidates")
    drop_cut(postings)
    joined = docs.select("*", *_row_key(names)).join(found, names, "left").drop(*names)
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(MARK), F.lit(STAND_IN))
    none = F.array().cast(SPAN)
    spans = []
    for order, rule in enumerate(rules):
        if plans[rule.kind]:
            check = F.array_contains(F.coalesce(kinds, F.array().cast("array<string>")), rule.kind)
        else:
            check = text.rlike(rule.pattern)
        spans.append(F.when(check, _spans(text, rule, order).cast(SPAN)).otherwise(none))
    return joined.withColumn("spans", F.array_sort(F.concat(*spans))).drop(kinds)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def brute_spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int, str]]:
    """The same spans by Python's re over one text, for tests."""
    out = []
    for order, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), order, m.end(), rule.kind))
    return sorted(out)
