"""Personal data by weak supervision, with DataFrame operations only.

Patterns propose candidate spans: strict ones (the base, which always stays when valid) and wider ones.
Four labelers vote on each candidate, for, against or not at all: the pattern's own validity, a gazetteer
(top-level domains, reserved address blocks, issuer prefixes, calling codes), words just before the span,
and the characters around it. Votes are counted over all candidates; expectation-maximisation estimates each
labeler's reliability and each kind's rate from the counts. A logistic classifier of spans is trained on the
resulting probabilities: it sees what the words around say and the span's own looks (length, groups of digits,
letter case, neighbours), and so tells apart spans with equal votes. It then decides on every candidate outside the base.

The driver holds counts of patterns of votes and looks only; how many there can be is fixed. Texts are matched where they are
read and only spans are stored; nothing is shuffled but the counts.

Positions come from ``split`` and ``regexp_extract_all`` with one pattern: what lies between the matches
and the matches, in turn. Patterns use possessive repeats, which Java runs without recursion, and start
only where a run starts (or the match before ended), so long runs cost linear time.

Defined results: a null text counts as empty; offsets are code points, the end is exclusive; rows that
repeat an id, or have none, are judged each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm.shared import require_columns, settle

KINDS = ("email", "ip", "card", "phone")
#: name: kind, whether its valid matches are the base, what a text must contain, the pattern.
PATTERNS = {
    "email": ("email", True, "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", True, r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("card", True, r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("phone", True, r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "email_spelt": (
        "email",
        False,
        r"[\[(](?:at|AT)[\])]",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++",
    ),
    "phone_local": ("phone", False, r"[0-9]{3}[.-][0-9]{4}", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
}
LABELERS = ("shape", "gazetteer", "context", "edges")

# Word lists, prefixes and codes that the labelers look up.
DOMAINS = "com org net edu gov mil int io info biz de fr es it nl be at ch pl pt se no dk fi uk ie ru cn jp kr in br mx ca au eu us".split()
CALLING_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "212 213 216 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 880 886 961 962 965 966 971 972 974"
).split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6011|64[4-9]|65|35|62)"
CONTEXT = {
    "email": "(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|server|host|address|client|from)",
    "card": "(?i)(?:card|visa|master|amex|credit|payment|tarjeta|carte|karte)",
    "phone": "(?i)(?:phone|tel|call|mobile|cell|fax|telefon|whatsapp)",
}
AGAINST = r"(?i)(?:\bv(?:ersion|er)?\.?|section|isbn|issn|order|invoice|serial|build|release|chapter|figure)[\x20:#.]*$"
#: Characters before a span that the context labeler reads.
BEFORE = 30
#: Matches whose places are summed up together.
BLOCK = 64


def _matches(text: Column, need: str, pattern: str) -> tuple[Column, Column]:
    """Matches of a pattern and what lies between them; nothing for texts that can't have any."""
    can = (F.instr(text, need) > 0) if need == "@" else text.rlike(need)
    none = F.array().cast("array<string>")
    return F.when(can, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(can, F.split(text, pattern, -1)).otherwise(none)


def _scan(size: Column, element: Callable[[Column], Column], zero: Column, step: Callable, result: Callable, kind: str) -> Column:
    """Running fold of ``element(i)`` for i below ``size``: for each ``result(state before, element)``, of the given type.

    Arrays grow by copying, so elements are gathered in blocks, and blocks in one array. What ``element`` looks into
    must be a column, since an expression would be evaluated for each i.
    """
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, i: Column) -> Column:
        x = element(i)
        return F.struct(step(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(result(acc["s"], x))).alias("out"))

    def block(acc: Column, at: Column) -> Column:
        inner = F.aggregate(F.sequence(at, F.least(at + BLOCK, size) - 1), F.struct(acc["s"].alias("s"), none.alias("out")), one)
        return F.aggregate(F.array(inner), acc, lambda a, i: F.struct(i["s"].alias("s"), F.concat(a["out"], F.array(i["out"])).alias("out")))

    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, F.struct(zero.alias("s"), nothing.alias("out")), block, lambda acc: F.flatten(acc["out"]))


def _placed(found: Column, between: Column) -> Column:
    """start, end, value, and the characters before and after, of each match; places in code points.

    ``before`` reaches back BEFORE characters, but not behind the match before the last one.
    """
    text = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
    gap = lambda i: F.length(text(between, i))

    def span(at: Column, i: Column) -> Column:
        value, tail = text(found, i), F.lit(BEFORE)
        before = F.concat(F.right(text(between, i - 1), tail), F.right(text(found, i - 1), tail), F.right(text(between, i), tail))
        start = at + gap(i)
        return F.struct(
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            value.alias("value"),
            F.right(before, tail).alias("before"),
            F.substring(F.concat(F.substring(text(between, i + 1), 1, 1), F.substring(text(found, i + 1), 1, 1)), 1, 1).alias("after"),
        )

    kind = "struct<start:int,end:int,value:string,before:string,after:string>"
    return _scan(F.size(found), lambda i: i, F.lit(0), lambda at, i: at + gap(i) + F.length(text(found, i)), span, kind)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, 1).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _sized(digits: Column, low: int, high: int) -> Column:
    return F.length(digits).between(low, high)


def valid(kind: str, value: Column) -> Column:
    """The base's check of a match."""
    digits = _digits(value)
    if kind == "card":
        return F.when(_sized(digits, 14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return _sized(digits, 10, 15)
    if kind == "ip":
        small = lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(F.split(value, r"\."), small)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "1").when(no, "0").otherwise("-")


def _gazetteer(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "email":
        last = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
        return _vote(last.isin(DOMAINS), ~last.rlike("^[a-z]{2,}$"))
    if kind == "ip":
        first = F.lpad(F.right(F.regexp_extract(value, "^[0-9]+", 0), F.lit(3)), 3, "0").cast("int")
        return _vote(first.between(1, 223), (first == 0) | (first > 239))
    if kind == "card":
        return _vote(digits.rlike(ISSUERS), ~digits.rlike("^[2-6]"))
    plus = value.startswith("+")
    known = F.lit(False)
    for n in (1, 2, 3):
        known = known | F.substring(digits, 1, n).isin([c for c in CALLING_CODES if len(c) == n])
    return _vote(plus & known, plus & ~known)


def _looks(value: Column, left: Column, right: Column) -> Column:
    """Five signs: length, groups of digits, case of letters, and the kinds of characters beside it."""
    beside = lambda c: F.when(c == "", "^").when(c.rlike(r"^\s$"), "s").when(c.rlike("^[A-Za-z0-9]$"), "a").when(c.rlike(r"^[:=#(\"'<]$"), "o").otherwise("p")
    groups = F.size(F.split(value, "[^0-9]+", -1)) - 1
    return F.concat(
        F.least(F.floor(F.length(value) / 4), F.lit(9)).cast("string"),
        F.least(groups, F.lit(6)).cast("string"),
        F.when(~value.rlike("[A-Za-z]"), "n").when(value.rlike("[A-Z]"), "u").otherwise("l"),
        beside(left),
        beside(right),
    )


def _candidates(name: str) -> Column:
    """array<struct<kind, start, end, base, votes, looks>> of one pattern's matches."""
    kind, base, _, _ = PATTERNS[name]

    def judged(s: Column) -> Column:
        value, before = s["value"], s["before"]
        ok = valid(kind, value) if base else F.lit(True)
        left, right = F.right(before, F.lit(1)), s["after"]
        joined = left.rlike("[A-Za-z0-9@/=_-]") | right.rlike("[A-Za-z0-9@/=_]")
        votes = F.concat(
            _vote(ok, ~ok) if base else F.lit("-"), _gazetteer(kind, value), _vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST)), _vote(~joined, joined)
        )
        return F.struct(
            F.lit(kind).alias("kind"),
            s["start"].cast("long").alias("start"),
            s["end"].cast("long").alias("end"),
            (ok if base else F.lit(False)).alias("base"),
            votes.alias("votes"),
            _looks(value, left, right).alias("looks"),
        )

    spans = F.col(f"_{name}")
    if name == "card":  # most runs of digits are far too short to be a candidate
        spans = F.filter(spans, lambda s: F.length(_digits(s["value"])).between(13, 19))
    return F.transform(spans, judged)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and candidates of every document, without its text."""
    require_columns(docs, [id_col, text_col])
    out = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for name, (_, _, need, pattern) in PATTERNS.items():
        found, between = _matches(F.col("_text"), need, pattern)
        out = out.withColumns({f"_{name}_m": found, f"_{name}_b": between})
    out = out.withColumns({f"_{n}": _placed(F.col(f"_{n}_m"), F.col(f"_{n}_b")) for n in PATTERNS})
    return out.select(id_col, F.concat(*[_candidates(n) for n in PATTERNS]).alias("found"))


@dataclass
class LabelModel:
    """Rates of each kind, reliabilities of each labeler, and the classifier's probability of each pattern."""

    rates: dict[str, float]
    reliability: dict[tuple[str, bool, str], float]  # (labeler, truth, vote) -> probability
    accept: dict[str, float]  # kind:votes:looks -> probability


def _logistic(rows: list[tuple[list[int], float, float]], size: int, rounds: int = 200, rate: float = 2.0) -> list[float]:
    """Weights of a logistic classifier on (features that are 1, target probability, weight) rows."""
    w, total = [0.0] * size, sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        slope = [1e-4 * x for x in w]
        for on, y, n in rows:
            miss = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in on))))) - y)
            for i in on:
                slope[i] += miss
        w = [a - rate * b for a, b in zip(w, slope)]
    return w


def learn(patterns: dict[tuple[str, str, str], int], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over counts of (kind, votes), then the classifier of (kind, votes, looks) on its probabilities."""
    counts: dict[tuple[str, str], int] = {}
    for (kind, votes, _), c in patterns.items():
        counts[kind, votes] = counts.get((kind, votes), 0) + c
    rates = dict.fromkeys(KINDS, 0.5)
    rel: dict[tuple[str, bool, str], float] = {}
    for name in LABELERS:  # labelers are taken to be better than chance at first, which fixes what truth means
        rel |= {(name, True, "1"): 0.6, (name, True, "0"): 0.1, (name, True, "-"): 0.3, (name, False, "1"): 0.1, (name, False, "0"): 0.6, (name, False, "-"): 0.3}

    def true_of(kind: str, votes: str) -> float:
        a, b = math.log(rates[kind]), math.log(1 - rates[kind])
        for name, v in zip(LABELERS, votes):
            a += math.log(rel[name, True, v])
            b += math.log(rel[name, False, v])
        return 1 / (1 + math.exp(max(-700.0, min(700.0, b - a))))

    for _ in range(rounds):
        p = {k: true_of(*k) for k in counts}
        for kind in KINDS:
            n = sum(c for (k, _), c in counts.items() if k == kind)
            rates[kind] = (sum(c * p[k, v] for (k, v), c in counts.items() if k == kind) + 1) / (n + 2)
        for j, name in enumerate(LABELERS):
            for truth in (True, False):
                mass = {v: 1.0 for v in "10-"}
                for key, c in counts.items():
                    mass[key[1][j]] += c * (p[key] if truth else 1 - p[key])
                for v in "10-":
                    rel[name, truth, v] = mass[v] / sum(mass.values())
    place: dict[tuple, int] = {}

    def on(kind: str, votes: str, looks: str) -> list[int]:
        signs = [(kind,), *((j, v) for j, v in enumerate(votes)), *((kind, j, v) for j, v in enumerate(looks))]
        return [place.setdefault(x, len(place)) for x in signs]

    rows = [(on(*key), true_of(*key[:2]), float(c)) for key, c in sorted(patterns.items())]
    w = _logistic(rows, len(place))
    accept = {":".join(k): 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in on(*k)))))) for k in patterns}
    return LabelModel(rates, rel, accept)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> tuple[DataFrame, LabelModel]:
    """(id, spans) of every document, spans an array of (kind, start, end, base) by start, then kind; and the model."""
    found = settle(candidates(docs, id_col, text_col))
    counted = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.looks").count().collect()
    model = learn({(r.kind, r.votes, r.looks): r["count"] for r in counted})
    taken = sorted(k for k, p in model.accept.items() if p >= threshold)
    wanted = lambda c: F.concat_ws(":", c["kind"], c["votes"], c["looks"]).isin(taken) if taken else F.lit(False)
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    short = lambda c: F.struct(c["start"].alias("start"), rank[c["kind"]].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))
    out = found.select(id_col, F.array_sort(F.transform(F.filter("found", lambda c: c["base"] | wanted(c)), short)).alias("found"))
    # Spans outside the base that overlap one of the base are dropped: the base's furthest end before, and its next start.
    kind = "struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean,clash:boolean>"

    def passed(name: str, zero: int, bound: Callable, clash: Callable) -> Column:
        step = lambda s, c: F.when(c["base"], bound(s, c)).otherwise(s)
        flag = lambda s, c: F.struct(*[c[f].alias(f) for f in ("start", "rank", "end", "kind", "base")], (clash(s, c) & ~c["base"]).alias("clash"))
        return F.filter(_scan(F.size(name), lambda i: F.get(name, i), F.lit(zero).cast("long"), step, flag, kind), lambda c: ~c["clash"])

    after = passed("found", -1, lambda s, c: F.greatest(s, c["end"]), lambda s, c: s > c["start"])
    before = F.reverse(passed("_back", 1 << 60, lambda s, c: F.least(s, c["start"]), lambda s, c: s < c["end"]))
    mixed = F.exists("found", lambda c: ~c["base"])
    plain = F.transform("found", lambda c: F.struct(*[c[f].alias(f) for f in ("start", "rank", "end", "kind", "base")], F.lit(False).alias("clash")))
    out = out.select(id_col, F.when(mixed, after).otherwise(plain).alias("_after"))
    out = out.withColumn("_back", F.reverse("_after"))
    out = out.select(id_col, F.when(F.exists("_after", lambda c: ~c["base"]), before).otherwise(F.col("_after")).alias("found"))
    spans = F.transform("found", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))
    return out.select(id_col, spans.alias("spans")), model
