"""Personal data by weak supervision, with DataFrame functions only.

Regexes propose spans. For the kinds without a fixed form - secrets given as name=value, key-shaped tokens and names after a
title - three labelers vote on every proposal, each by evidence of its own: the value's form, a gazetteer (what the value
is called, how issued keys begin, given names), and the words before the span. Votes are counted by pattern,
expectation-maximisation over those few counts estimates how reliable each labeler is, and the posteriors train a logistic
span classifier on features of the value, none of them a vote, again over counts by pattern. Spans that the classifier
accepts, and no others, are added to the base kinds, whose rules decide alone. Every step is a Column or an aggregate; the driver sees pattern counts only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
#: The base kinds in their order: when a text can hold one at all, and the kind's pattern. The patterns match exactly what
#: the contract's do; possessive quantifiers and the look-behinds only keep Java from trying starts that cannot match.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: What stands before a secret: its name and the sign.
ASSIGNS = r"[A-Za-z0-9_]{3,}+\x20*+[=:]\x20*+"
#: Issued keys, each beginning with its own alphabet.
SHAPES = r"AIza[A-Za-z0-9_-]{30,}+|gh[opsur]_[A-Za-z0-9]{30,}+|github_pat_[A-Za-z0-9_]{30,}+|xox[abeoprs]-[A-Za-z0-9-]{10,}+"
#: Proposals of the added kinds: kind -> pattern. No upper bounds: a match ends where its alphabet does.
ADDED = {
    "secret": rf"(?<![A-Za-z0-9_])(?=[0-9_]*+[A-Za-z]){ASSIGNS}\x22?[A-Za-z0-9/+_-]{{12,}}+\x22?",
    "key": rf"\b(?:{SHAPES}|[A-Z]{{4}}[A-Z0-9]{{12,}}+\b)",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
}
#: Gazetteer: names that secrets go by, and beginnings of issued keys.
WORDS = "password|passwd|pwd|secret|token|api_?key|apikey|access_?key|auth|credential"
ISSUED = "AKIA|ASIA|AIza|gh[opsur]_|github_pat_|xox[abeoprs]-"
#: Words that tell of personal data nearby.
AROUND = "login|account|user|contact|signed|dear|credential|key|token|password|secret"
LABELERS = ("form", "gazetteer", "context")
FEATURES = ("digits", "letters", "long", "mixed", "varied", "cases", "quoted", "words")
#: Frequent given names, the gazetteer of personal names.
GIVEN = """
james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles
karen christopher lisa daniel nancy matthew betty anthony margaret mark sandra donald ashley steven kimberly paul emily andrew donna
joshua michelle kenneth carol kevin amanda brian dorothy george melissa edward deborah peter anna hans maria jean pierre marie jacques
claude juan jose carlos ana luis carmen pedro laura paolo giulia marco francesca ivan olga sergei elena wei li ming hiroshi yuki ahmed
fatima mohammed aisha omar priya raj sven ingrid lars astrid
"""


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, t>>: code points from s to e (exclusive) and the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,t:string>>)").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.concat(acc["all"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("t")))).alias("all"))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: acc["all"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right, the last excluded, counts twice."""
    each = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.when(d.try_cast("int") > 4, d.try_cast("int") * 2 - 9).otherwise(d.try_cast("int") * 2)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def part_fits(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def base_spans(text: Column) -> dict[str, Column]:
    """The base kinds' spans after their checks, kind by kind; a text that lacks a kind's marks is not searched for it."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,t:string>>)")
    size = lambda x: F.length(digits(x["t"]))
    rules = {
        "email": (F.contains(text, F.lit("@")), EMAIL, None),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), IP, lambda x: F.forall(F.split(x["t"], r"\."), part_fits)),
        "card": (text.rlike(r"[0-9][\x20-]?[0-9]"), CARD, lambda x: size(x).between(16, 19) & luhn(digits(x["t"]))),
        "phone": (text.rlike(r"\+[0-9]"), PHONE, lambda x: size(x).between(8, 15)),
    }
    out = {}
    for kind, (gate, pattern, check) in rules.items():
        found = spans(text, pattern)
        out[kind] = F.when(gate, F.filter(found, check) if check else found).otherwise(none)
    return out


def proposals(text: Column) -> Column:
    """The added kinds' proposals with their words before: array<struct<kind, s, e, t, before>>."""
    none = F.expr("cast(array() as array<struct<kind:string,s:int,e:int,t:string,before:string>>)")
    gates = {"secret": text.rlike(r"[=:]\x20*+\x22?[A-Za-z0-9/+_-]{12}"), "key": text.rlike(f"[A-Z]{{4}}[A-Z0-9]{{12}}|{SHAPES}"), "name": text.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}")}

    def of(kind: str) -> Column:
        before = lambda x: F.substring(text, F.greatest(x["s"] - 39, F.lit(1)), F.least(x["s"], F.lit(40)))
        made = lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), before(x).alias("before"))
        return F.when(gates[kind], F.transform(spans(text, ADDED[kind]), made)).otherwise(none)

    return F.concat(*map(of, ADDED))


def value_of(t: Column) -> Column:
    """What a proposal assigns, or all of it."""
    return F.regexp_replace(t, f"^{ASSIGNS}", "")


def votes(kind: Column, t: Column, before: Column) -> list[Column]:
    """What each labeler says: 1 personal, 0 not."""
    value = value_of(t)
    form = F.when(kind == "name", t.rlike(r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}")).otherwise(value.rlike("[0-9]") & value.rlike("[A-Za-z]"))
    given = "|".join(GIVEN.split())
    listed = F.when(kind == "name", F.lower(t).rlike(rf"^\w+\.?\x20(?:{given})\b")).when(kind == "key", t.rlike(f"^(?:{ISSUED})")).otherwise(F.lower(t).rlike(f"^(?:{WORDS})"))
    near = F.lower(before).rlike(AROUND)
    return [F.coalesce(x, F.lit(False)).cast("int") for x in (form, listed, near)]


def features(kind: Column, t: Column, before: Column) -> list[Column]:
    value = value_of(t)
    bare = F.regexp_replace(value, "\x22", "")
    n = F.length(bare)
    few = F.length(digits(bare))
    flags = [
        few * 4 >= n, F.length(F.regexp_replace(bare, "[^A-Za-z]", "")) * 4 >= n, n >= 16, bare.rlike("[0-9][A-Za-z]") & bare.rlike("[A-Za-z][0-9]"),
        F.size(F.array_distinct(F.split(bare, ""))) >= 10, bare.rlike("[a-z]") & bare.rlike("[A-Z]"), value.startswith("\x22"), bare.rlike(r"\x20\p{L}+\x20"),
    ]
    return [F.coalesce(x, F.lit(False)).cast("int") for x in flags]


@dataclass(frozen=True)
class Model:
    """By kind: the labelers' reliabilities, and the span classifier's weights with its bias last."""

    reliability: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    weights: dict[str, list[float]] = field(default_factory=dict)


def em(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], list[tuple[float, float]]]:
    """Posteriors by vote pattern, and each labeler's chance of a vote on true and on false spans. Starts from the majority."""
    width = len(LABELERS)
    post = {v: (sum(v) + 0.5) / (width + 1) for v in counts}
    rates = [(0.8, 0.2)] * width
    for _ in range(rounds):
        yes = sum(post[v] * n for v, n in counts.items())
        no = sum((1 - post[v]) * n for v, n in counts.items())
        # two made-up votes each way keep the chances inside (0, 1)
        rates = [
            (
                (sum(post[v] * n * v[k] for v, n in counts.items()) + 1.6) / (yes + 2),
                (sum((1 - post[v]) * n * v[k] for v, n in counts.items()) + 0.4) / (no + 2),
            )
            for k in range(width)
        ]
        prior = (yes + 1) / (yes + no + 2)
        for v in counts:
            odds = math.log(prior / (1 - prior))
            for k, (p, q) in enumerate(rates):
                odds += math.log(p / q) if v[k] else math.log((1 - p) / (1 - q))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, rates


def logistic(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 400, rate: float = 1.0, decay: float = 0.02) -> list[float]:
    """Weights, bias last, of a classifier over (features, share of true spans, number of spans)."""
    total = sum(n for _, _, n in rows) or 1
    w = [0.0] * (len(FEATURES) + 1)
    for _ in range(rounds):
        grad = [decay * x for x in w[:-1]] + [0.0]
        for x, y, n in rows:
            z = w[-1] + sum(a * b for a, b in zip(w, x, strict=False))
            err = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * n / total
            for k, v in enumerate(x):
                grad[k] += err * v
            grad[-1] += err
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def fit(docs: DataFrame) -> Model:
    """EM and the classifier over the proposals of all documents. Votes and features are counted by pattern, so at most
    kinds * 2^votes * 2^features rows come to the driver, whatever the input."""
    each = docs.select(F.explode(proposals(F.coalesce("text", F.lit("")))).alias("p"))
    v, x = votes(F.col("p.kind"), F.col("p.t"), F.col("p.before")), features(F.col("p.kind"), F.col("p.t"), F.col("p.before"))
    rows = each.groupBy(F.col("p.kind").alias("kind"), F.array(*v).alias("v"), F.array(*x).alias("x")).count().collect()
    model = Model()
    for kind in ADDED:
        own = sorted((tuple(r.v), tuple(r.x), r["count"]) for r in rows if r.kind == kind)
        counts: dict[tuple[int, ...], int] = {}
        for votes_, _, n in own:
            counts[votes_] = counts.get(votes_, 0) + n
        post, model.reliability[kind] = em(counts)
        model.weights[kind] = logistic([(x_, post[v_], n) for v_, x_, n in own])
    return model


def accepted(model: Model, p: Column) -> Column:
    """The classifier's probability of a proposal is at least one half."""
    kind, t, before = p["kind"], p["t"], p["before"]
    x = features(kind, t, before)
    out = F.lit(False)
    for k, w in model.weights.items():
        z = F.lit(w[-1])
        for a, b in zip(w, x, strict=False):
            z = z + F.lit(a) * b
        out = F.when(kind == k, z >= 0).otherwise(out)
    return out


def named(kind: str, found: Column) -> Column:
    """Spans as kind:start:end."""
    return F.transform(found, lambda x: F.concat(F.lit(kind + ":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, one array of spans (s, e, t) by base kind, and added, spans with their kind.

    Null text counts as empty; rows repeated are rows of their own. Positions are code points, ends exclusive.
    """
    model = model or fit(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    got = docs.select("doc_id", *[c.alias(k) for k, c in base_spans(text).items()], proposals(text).alias("proposed"))
    overlap = lambda p: sum([F.exists(k, lambda b: (b["s"] < p["e"]) & (p["s"] < b["e"])).cast("int") for k in BASE[1:]], F.exists(BASE[0], lambda b: (b["s"] < p["e"]) & (p["s"] < b["e"])).cast("int")) == 0
    return got.select("doc_id", *BASE, F.filter("proposed", lambda p: accepted(model, p) & overlap(p)).alias("added"))


def pii(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans: one row per input row.

    spans lists the base kinds in their order and then the added kinds by name, each by start. Texts without personal data
    have the digest of the empty string and empty spans. Empty tables give no rows.
    """
    found = find(docs)
    base = F.array_join(F.flatten(F.array(*[named(k, F.col(k)) for k in BASE])), ",")
    own = lambda kind: F.filter("added", lambda p: p["kind"] == kind)
    more = F.array_join(F.flatten(F.array(*[named(k, own(k)) for k in sorted(ADDED)])), ",")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(more, F.lit(""))).alias("spans"),
        (sum([F.size(k) for k in BASE], F.size("added"))).cast("long").alias("n_spans"),
    )
