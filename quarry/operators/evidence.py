"""Queries as data: compiling them, their constraints, and what of them a text supports.

A query is compiled on the driver to a small plan; whatever touches the corpus is a column expression or a
join on stored rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import fold_value

#: Grammar words of queries in Spanish, English and German and Chinese particles, the auxiliary that a
#: question drops too, and words that make a query a question.
STOP = frozenset(
    (
        "a al como cómo con cual cuales cuál cuáles de del donde dónde el en encuentra encontrar evidencia existe existen la las hay "
        "informacion información lo los dame favor me necesito podria podrías podrias puede puedes quiero saber muestra mostrar o para "
        "por que qué sobre un una y "
        "an and are as at about by can could do does did evidence find for from in information is of on or show the there to please "
        "what where which with you "
        "auf das dem den der des die ein eine einem einen einer eines es evidenz für finde finden gibt im mit nachweis bitte kann können "
        "konnte könnte mir oder uber und über von was welche welcher welches wo "
        "的 了 吗 嗎 呢"
    ).split()
)
AUXILIARY = "se"
ASKING = frozenset("what which where when who how que qué cual cuál donde dónde cuando cuándo quien quién como cómo was welche wo wann wer wie".split())
NEGATIONS = frozenset("no not never sin nunca jamas without ohne nicht kein keine".split())
RELATIONS = frozenset("belong belongs relación relationship depende depends pertenece pertenecen usa uses".split())
TIMES = frozenset("antes after before después histórico historical versión version".split())
HAN = r"[㐀-䶿一-鿿豈-﫿]"


@dataclass(frozen=True)
class QueryPlan:
    """What to search for, rung by rung, and which rankings to ask."""

    text: str
    terms: list[str]
    rungs: list[tuple[str, list[list[str]]]] = field(default_factory=list)  # name, alternatives of terms that must all be there
    substrings: list[str] = field(default_factory=list)
    intents: list[str] = field(default_factory=list)


def compile_query(text: str, most_terms: int = 32, most_chars: int = 4096) -> QueryPlan:
    """Terms without repeats, then rungs: all terms (for a question, its content terms), content terms, any two of three to five.

    No rung may drop a negation, and one with Han text goes to substrings instead.
    """
    if not text.strip() or len(text) > most_chars:
        raise ValueError("a query has between one and most_chars characters")
    words = list(dict.fromkeys(w.lower() for w in re.findall(r"[^\W_]+", text)))
    if not words or len(words) > most_terms:
        raise ValueError("a query has between one and most_terms terms")
    asked = words[0] in ASKING
    content = [w for w in words if w not in STOP and not (asked and (w == AUXILIARY or w in ASKING))]
    question = asked and bool(content)
    rungs = [("question_content_terms_all", [content])] if question else [("strict_all_terms", [words])]
    if not question and content and content != words:
        rungs.append(("content_terms_all", [content]))
    han = [re.sub("[的了吗嗎呢]", "", run) for run in re.findall(f"{HAN}+", text)]
    substrings = [x for x in han if len(x) >= 2]
    if substrings:
        substrings += [w for w in content if not re.search(HAN, w)]
    elif 3 <= len(content) <= 5 and not any(fold_value(w) in NEGATIONS for w in words):
        pairs = [[a, b] for i, a in enumerate(content) for b in content[i + 1 :]]
        rungs.append(("content_terms_any_two", pairs))
    return QueryPlan(text, words, rungs, substrings, intents(text, set(words)))


def intents(text: str, words: set[str]) -> list[str]:
    """exact, lexical, semantic, relational and temporal, in the order in which they are run."""
    exact = re.search(r"[/\\]\w|\b[0-9a-fA-F]{16,64}\b|\b[A-Za-z][\w.]*[-_/]\d|\.\w{2,4}\b", text)
    timely = words & TIMES or re.search(r"\b(?:19|20)\d\d\b", text)
    found = ["exact"] if exact else []
    found += ["lexical", "semantic"]
    return found + (["relational"] if words & RELATIONS else []) + (["temporal"] if timely else [])


def ranking_steps(plan: QueryPlan, limit: int, most: int) -> list[tuple[int, str, int]]:
    """(order, ranking, candidates): every ranking over-fetches three times the limit, up to a maximum."""
    names = {"exact": ["exact"], "lexical": ["lexical"], "semantic": ["semantic", "title"], "relational": ["relational"], "temporal": ["temporal"]}
    rankings = [r for i in plan.intents for r in names[i]]
    rankings.insert(rankings.index("title") + 1, "catalogue")
    return [(i, r, min(most, 3 * limit)) for i, r in enumerate(rankings)]


def expand_query(text: str, concepts: dict[str, list[str]], most: int = 8) -> str:
    """Add the labels of concepts whose aliases the query uses, those that it lacks, up to a number."""
    folded, extra = f" {fold_value(text)} ", []
    for label, aliases in concepts.items():
        used = any(f" {fold_value(a)} " in folded for a in aliases)
        if used and f" {fold_value(label)} " not in folded and len(extra) < most:
            extra.append(label)
    return " | ".join([text, *extra])


def matches_rung(words: Column, alternatives: list[list[str]]) -> Column:
    """Whether a text's words hold all terms of one of the alternatives."""
    out = F.lit(False)
    for terms in alternatives:
        out = out | (F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) == len(set(terms)))
    return out


def climb(docs: DataFrame, key: str, text: str, plan: QueryPlan) -> DataFrame:
    """key, rung: the documents of the first rung that has any; all rungs are decided in one pass."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    rung = F.lit(None).cast("int")
    tests = [matches_rung(F.col("words"), a) for _, a in plan.rungs]
    if plan.substrings:
        hit = F.lit(True)
        for s in plan.substrings:
            hit = hit & F.lower(text).contains(s.lower())
        tests.append(hit)
    for i in reversed(range(len(tests))):
        rung = F.when(tests[i], i).otherwise(rung)
    rows = docs.select(key, text, words.alias("words")).select(key, rung.alias("rung")).filter("rung is not null")
    best = rows.agg(F.min("rung").alias("best"))
    return rows.crossJoin(F.broadcast(best)).filter("rung = best").select(key, "rung")  # best is one row


# --- structured constraints --------------------------------------------------------------------------

MOST_SPAN, MOST_CONSTRAINTS = 1024, 16


def constraints(query: str) -> list[tuple[str, str]]:
    """(kind, pattern) of the identifiers, dates and measurements that a query names."""
    out, rest = [], query[:4096]
    for m in re.finditer(r"\b[A-Za-z][A-Za-z0-9_.]*(?:[-_/][A-Za-z0-9_.]+)*[-_/][0-9][A-Za-z0-9_.-]*\b", rest):
        out.append(("identifier", rf"(?i)(?<![\w-]){re.escape(m[0])}(?![\w-])"))
    for m in re.finditer(r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)", rest):
        y, mo, d = m.groups()
        forms = [m[0], f"0?{int(d)}[/.]0?{int(mo)}[/.]{y}"]
        out.append(("date", rf"(?<!\d)(?:{'|'.join(forms)})(?!\d)"))
    for m in re.finditer(r"(?<![\w.,-])(\d+(?:[.,]\d+)?)\s*(kv|kw|mw|hz|mm|cm|kg|v|a|w|m|g|%)(?!\w)", rest, re.I):
        out.append(("measurement", rf"(?i)(?<![\w.,-]){re.escape(m[1]).replace(',', '[.,]')}\s*{re.escape(m[2])}(?!\w)"))
    dates = "".join(re.findall(r"\d{4}-\d{2}-\d{2}", rest))
    for m in re.finditer(r"(?<![\w-])(?<!\d[.,])\d{5,}(?!(?:[A-Za-z0-9-]|[.,]\d))", rest):
        if m[0] not in dates:
            out.append(("number", rf"(?<![\w-]){m[0]}(?!(?:[A-Za-z0-9-]|[.,]\d))"))
    seen = dict.fromkeys(out)
    return [x for kind in ("identifier", "date", "measurement", "number") for x in [c for c in seen if c[0] == kind][:MOST_CONSTRAINTS]]


def tightest(spans: list[list[tuple[int, int]]]) -> tuple[int, int] | None:
    """The shortest stretch that holds one span of every list."""
    events = sorted((a, b, i) for i, own in enumerate(spans) for a, b in own)
    best, have = None, {}
    for a, b, i in events:
        have[i] = (a, b)
        if len(have) == len(spans):
            first, last = min(x for x, _ in have.values()), max(y for _, y in have.values())
            if best is None or last - first < best[1] - best[0]:
                best = (first, last)
    return best


SUPPORT = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("coherent", T.BooleanType()),
        T.StructField("hard_mismatch", T.BooleanType()),
        T.StructField("missing", T.ArrayType(T.StringType())),
        T.StructField("span_chars", T.IntegerType()),
        T.StructField("span_terms", T.IntegerType()),
    ]
)


def structured_support(text: Column, query: str) -> Column:
    """What of a query's constraints a text holds: coherent if all are there within MOST_SPAN characters."""
    wanted = [(kind, re.compile(p)) for kind, p in constraints(query)]

    def judge(value: str | None) -> tuple:
        if not wanted:
            return ("not_applicable", False, False, [], None, None)
        spans = [[m.span() for m in p.finditer(value or "")] for _, p in wanted]
        missing = [kind for (kind, _), own in zip(wanted, spans, strict=True) if not own]
        if missing:
            return ("mismatch", False, True, missing, None, None)
        a, b = tightest(spans)
        near = b - a <= MOST_SPAN
        return ("coherent" if near else "mismatch", near, False, [], b - a, len((value or "")[a:b].split()))

    @F.pandas_udf(SUPPORT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([judge(v) for v in batch], columns=[f.name for f in SUPPORT.fields])

    return run(text)


def prefer_coherent(hits: DataFrame, support: str = "support") -> DataFrame:
    """Hard mismatches go once a query has coherent evidence; abstains says that nothing coherent was found."""
    some = hits.groupBy("query_id").agg(F.bool_or(f"{support}.coherent").alias("some"))
    rows = hits.join(some, "query_id").filter(~(F.col("some") & F.col(f"{support}.hard_mismatch")))
    return rows.withColumn("abstains", ~F.col("some")).drop("some")


#: How a text says that an event did not happen, or that it is no record of events.
DENIED = r"\b(?:no (?:occurred|hubo|ocurrio|se registro|se presento)|(?:no|without|sin) {event}|{event} (?:did not occur|was not observed|no ocurrio))\b"
NOT_A_RECORD = r"\b(?:is not a record|no constituye (?:un )?registro|example only|solo (?:es )?un ejemplo|hypothetical|hipotetico)\b"


def counter_evidence(folded: Column, event: str) -> Column:
    """Reasons why a folded text speaks against an observed event; empty is no proof that it happened."""
    denied = folded.rlike(DENIED.replace("{event}", re.escape(event)))
    disclaimed = folded.rlike(NOT_A_RECORD) & folded.contains(event)
    return F.array_compact(
        F.array(
            F.when(denied, "literal_requested_event_occurrence_is_negated"),
            F.when(disclaimed, "source_explicitly_limits_observed_event_evidence"),
        )
    )


SNIPPET = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("snippet", T.StringType())])


def densest_window(text: str | None, terms: list[str], size: int) -> tuple[int, str]:
    """Start and text of the window that begins at a term and holds most distinct terms; the first of equals."""
    text = text or ""
    low = text.lower()
    places = sorted((m.start(), t) for t in dict.fromkeys(terms) for m in re.finditer(re.escape(t), low))
    best, start, held, ahead = 0, 0, {}, 0
    for at, term in places:
        while ahead < len(places) and places[ahead][0] + len(places[ahead][1]) <= at + size:
            held[places[ahead][1]] = held.get(places[ahead][1], 0) + 1
            ahead += 1
        if len(held) > best:
            best, start = len(held), at
        if held.get(term):
            held[term] -= 1
            if not held[term]:
                del held[term]
    return start, text[start : start + size]


def densest_snippet(text: Column, terms: list[str], size: int) -> Column:
    """struct(start, snippet) of each text's densest window; linear in its occurrences."""

    @F.pandas_udf(SNIPPET)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([densest_window(v, terms, size) for v in batch], columns=["start", "snippet"])

    return run(text)


def evidence_matrix(cases: DataFrame, by: list[str]) -> DataFrame:
    """Confusion of expected and predicted support; an abstention is neither a true nor a false negative.

    cases: by..., expected boolean, predicted boolean or null.
    """
    e, p = F.col("expected"), F.col("predicted")
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(e & p).alias("true_positive"),
        F.count_if(~e & p).alias("false_positive"),
        F.count_if(e & ~p).alias("false_negative"),
        F.count_if(~e & ~p).alias("true_negative"),
        F.count_if(p.isNull()).alias("abstained"),
    )


def rehydrate(citations: DataFrame, owners: DataFrame) -> DataFrame:
    """Citations with their owner's text at the cited place and whether it still is what was cited.

    citations: citation, owner_id, start, end, sha256; owners: owner_id, text.
    """
    rows = citations.join(owners, "owner_id", "left")
    cited = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    status = F.when(F.col("text").isNull(), "owner_missing").when(F.col("end") > F.length("text"), "locator_out_of_range")
    status = status.when(F.sha2(cited, 256) == F.col("sha256"), "verified").otherwise("text_changed")
    return rows.select("citation", "owner_id", cited.alias("cited"), status.alias("status"))


def evidence_graph(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of selected evidence: queries cite evidence, evidence belongs to resources."""
    q, r, e = (F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("query:", "query_id"), ("resource:", "resource"), ("evidence:", "evidence")))
    edges = hits.select(q.alias("from"), e.alias("to"), F.lit("cites").alias("relation")).unionByName(
        hits.select(e.alias("from"), r.alias("to"), F.lit("belongs_to").alias("relation"))
    )
    edges = edges.distinct()
    nodes = edges.select(F.col("from").alias("node")).union(edges.select("to")).distinct()
    return nodes.withColumn("kind", F.split("node", ":")[0]), edges
