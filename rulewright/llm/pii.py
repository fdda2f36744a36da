"""Personal data by candidate gradient boosting, with DataFrame and SQL functions only.

High-recall generators (regular expressions) propose spans, which may overlap. Each candidate gets features of its format
(digits, letters, separators, grouping, check digits) and its context (cue words before it, characters around it); boosted
trees, written out as SQL CASE expressions, score it, and thresholds calibrated for precision, one for each kind, select it.
The trees are fitted on the driver to seeded synthetic sentences whose spans are known, by the very expressions that score
documents.

Base spans are found by fixed patterns and always stay; the trees decide about all others. Of two candidates that overlap the
one further above its threshold stays. Spans count code points, end
exclusive. Null and empty texts have no spans, and very long texts are searched whole. Repeated rows give repeated results;
other columns pass through, but one that is called like a result gives way to it.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm._boost import Boosted, Isotonic, sigmoid

# Fixed patterns: leftmost, non-overlapping. Possessive quantifiers and the anchors (\G or no such character before) leave
# the matches as they are and keep the search linear on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this has no match of the kind.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
# Generators of further candidates, and what a text must contain to have one.
GENERATORS = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:at|AT) )[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{1,63}){1,4}", r"(?:at|AT|@)[\])}> ]"),
    "ip": (r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{1,4}:"),
    "card": (r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[ .-]?[0-9]{2,6}){2,4}(?![0-9A-Za-z])", r"[0-9]{4}"),
    "phone": (r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-][0-9]{3,4}(?![0-9A-Za-z])", r"[0-9]{3}[ .-][0-9]{3}"),
    "ssn": (r"(?<![0-9A-Za-z.-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z.-])", r"[0-9]{3}[ -][0-9]{2}[ -]"),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}"),
}
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
CUES = {
    "email": "mail|contact|write to|reach|address",
    "ip": "ip|host|address|server|login",
    "card": "card|visa|credit|debit|amex|payment",
    "phone": "phone|tel|call|mobile|fax|dial|whatsapp|cell",
    "ssn": "ssn|social|security|taxpayer",
    "iban": "iban|account|bank|transfer",
}
AGAINST = "version|order|invoice|isbn|sku|part|ref|page|item|serial|model|sha|hash|build|ticket|total|rev"
WINDOW = 28
FEATURES = ("k", "len", "digits", "letters", "seps", "groups", "luhn", "zone", "words", "distinct", "cue", "against", "tail", "before", "after")


def _luhn(digits: str) -> str:
    """SQL: whether a digit string passes the Luhn check."""
    r = f"reverse({digits})"
    return f"(length({digits}) > 0 AND aggregate(transform(sequence(1, greatest(length({digits}), 1)), i -> CAST(substring(IF(i % 2 = 0, translate({r}, '0123456789', '0246813579'), {r}), i, 1) AS INT)), 0, (a, b) -> a + coalesce(b, 0)) % 10 = 0)"


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, needs: str, kind: str) -> str:
    """SQL: array of (kind, s, e, t) of all matches, from the lengths of matches and of what lies between them."""
    q = _quote(pattern)
    return f"""CASE WHEN {text} RLIKE {_quote(needs)} THEN aggregate(
        arrays_zip(regexp_extract_all({text}, {q}, 0), split({text}, {q}, -1)),
        named_struct('p', 0, 'o', CAST(array() AS ARRAY<STRUCT<kind: STRING, s: INT, e: INT, t: STRING>>)),
        (a, z) -> named_struct('p', a.p + length(z.`1`) + coalesce(length(z.`0`), 0),
            'o', IF(z.`0` IS NULL, a.o, concat(a.o, array(named_struct('kind', '{kind}', 's', a.p + length(z.`1`), 'e', a.p + length(z.`1`) + length(z.`0`), 't', z.`0`))))),
        a -> a.o) ELSE CAST(array() AS ARRAY<STRUCT<kind: STRING, s: INT, e: INT, t: STRING>>) END"""


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


_BASE_TEST = {
    "email": "true",
    "ip": "forall(split(x.t, '[.]'), p -> length(regexp_replace(p, '^0+(?=.)', '')) <= 3 AND CAST(right(p, 3) AS INT) <= 255)",
    "card": f"length({_digits('x.t')}) BETWEEN 16 AND 19 AND {_luhn(_digits('x.t'))}",
    "phone": f"length({_digits('x.t')}) BETWEEN 8 AND 15",
}


def _candidate(text: str) -> str:
    """SQL: features of candidate x in text."""
    left = f"lower(substring({text}, greatest(x.s - {WINDOW}, 0) + 1, least(x.s, {WINDOW})))"
    cue = " ".join(f"WHEN '{k}' THEN {left} RLIKE '\\\\b(?:{c})'" for k, c in CUES.items())
    number = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    d = _digits("x.t")
    return f"""named_struct('kind', x.kind, 's', x.s, 'e', x.e,
        'k', CAST(CASE x.kind {number} END AS DOUBLE), 'len', CAST(length(x.t) AS DOUBLE), 'digits', CAST(length({d}) AS DOUBLE),
        'letters', CAST(length(regexp_replace(x.t, '[^A-Za-z]', '')) AS DOUBLE), 'seps', CAST(length(regexp_replace(x.t, '[^ .()-]', '')) AS DOUBLE),
        'groups', CAST(size(split(x.t, '[^A-Za-z0-9]+')) AS DOUBLE), 'luhn', CAST({_luhn(d)} AS DOUBLE),
        'zone', CAST(x.t RLIKE '(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$' AS DOUBLE),
        'words', CAST(CAST(x.t RLIKE '[\\\\[({{<] ?(?:at|AT|@)' AS INT) * 2 + CAST(x.t RLIKE '(?:[\\\\[({{<] ?(?:dot|DOT|[.])| (?:dot|DOT) )' AS INT) AS DOUBLE),
        'distinct', CAST(size(array_distinct(split({d}, ''))) AS DOUBLE),
        'cue', CAST(CASE x.kind {cue} ELSE false END AS DOUBLE), 'against', CAST({left} RLIKE '\\\\b(?:{AGAINST})' AS DOUBLE),
        'tail', CAST(length(regexp_extract(x.t, '[0-9]+$', 0)) AS DOUBLE),
        'before', CAST(substring({text}, x.s, IF(x.s > 0, 1, 0)) RLIKE '[A-Za-z0-9#/=_]' AS DOUBLE),
        'after', CAST(substring({text}, x.e + 1, 1) RLIKE '[A-Za-z0-9/=_%]' AS DOUBLE))"""


def _candidates(text: str) -> str:
    """SQL: candidates of all generators with their features."""
    each = ", ".join(_spans(text, pattern, needs, kind) for kind, (pattern, needs) in GENERATORS.items())
    return f"transform(concat({each}), x -> {_candidate(text)})"


def _synthetic(n: int, seed: int) -> list[tuple[str, int, int]]:
    """(text, start, end) sentences; start is -1 where nothing in it is personal data. Invented templates and values."""
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rnd.choice(("ka", "lo", "mi", "tor", "en", "sa", "ver", "du", "pel")) for _ in range(rnd.randint(1, 3)))

    def luhn(k: int, prefix: str) -> str:
        body = prefix + d(k - 1 - len(prefix))
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def grouped(s: str, sizes: tuple[int, ...], sep: str) -> str:
        out, i = [], 0
        for k in sizes:
            out.append(s[i : i + k])
            i += k
        return sep.join([*out, s[i:]] if i < len(s) else out)

    zone = lambda: rnd.choice(("com", "org", "net", "de", "fr"))
    good = {
        "email": lambda: rnd.choice(("{a} [at] {b} [dot] {z}", "{a}(at){b}(dot){z}", "{a} at {b} dot {z}", "{a}[at]{b}.{z}", "{a} (at) {b}.{z}")).format(a=w() + d(rnd.randint(0, 2)), b=w(), z=zone()),
        "ip": lambda: ":".join("".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(1, 4))) for _ in range(8)),
        "card": lambda: rnd.choice((lambda: grouped(luhn(15, "37"), (4, 6, 5), rnd.choice(" -")), lambda: grouped(luhn(16, "4"), (4, 4, 4, 4), "."), lambda: luhn(15, "34")))(),
        "phone": lambda: rnd.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(str(rnd.randint(2, 9)) + d(2), str(rnd.randint(2, 9)) + d(2), d(4)),
        "ssn": lambda: f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{d(3)}{rnd.randint(1, 9)}",
        "iban": lambda: rnd.choice(("DE", "FR", "ES", "NL")) + grouped(d(20), (2, 4, 4, 4, 4), rnd.choice(("", " "))),
    }
    bad = [
        lambda: f"{w()} at {w()}.{w()}",
        lambda: f"{w()} at {w()}. {w()}",
        lambda: f"looked at {w()}.{w()}",
        lambda: f"order {d(4)}-{d(4)}-{d(4)}",
        lambda: f"version {d(3)}.{d(3)} {d(3)}",
        lambda: f"{rnd.randint(1900, 2030)}-{d(4)} {d(3)}",
        lambda: f"invoice {d(4)} {d(4)} {d(4)} {d(4)}",
        lambda: f"part {d(3)}-{d(3)}-{d(4)}",
        lambda: f"ref {d(3)}-{d(2)}-{d(4)}",
        lambda: f"{d(4)} {d(4)} {d(4)}",
        lambda: f"{d(2)} {d(3)} {d(3)}",
        lambda: f"{d(3)} {d(3)}.{d(3)} units",
        lambda: f"{d(16)}",
        lambda: f"sha {d(4)}{d(6)}{d(6)}",
        lambda: f"model AB{d(2)} {w().upper()[:4].ljust(4, 'X')} {d(4)} {d(4)}",
        lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}",
        lambda: ":".join(d(2) for _ in range(8)) + " ticket",
    ]
    rows = []
    for _ in range(n):
        lead = " ".join(w() for _ in range(rnd.randint(0, 6)))
        tail = rnd.choice(("", ".", ",", " " + w(), ". " + w()))
        if rnd.random() < 0.5:
            kind = rnd.choice(KINDS)
            value = good[kind]()
            cue = rnd.choice(CUES[kind].split("|")) + rnd.choice((" ", ": ", " is ")) if rnd.random() < (0.5 if kind != "ssn" else 0.9) else ""
            head = f"{lead} {cue}" if lead else cue
            rows.append((head + value + tail, len(head), len(head) + len(value)))
        else:
            rows.append((f"{lead} {rnd.choice(bad)()}{tail}".strip(), -1, -1))
    return rows


_models: dict[tuple, tuple[str, dict[str, float]]] = {}


def fit(spark: SparkSession, n: int = 8000, seed: int = 7, precision: float = 0.99) -> tuple[str, dict[str, float]]:
    """(SQL of the margin, least margin that is selected for each kind), from n synthetic sentences.

    Three quarters fit the trees; on the rest isotonic calibration of each kind gives probabilities, and its threshold is
    the least margin from which on the calibrated probability is at least precision.
    """
    key = (n, seed, precision)
    if key not in _models:
        rows = _synthetic(n, seed)
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, a int, b int").coalesce(1)
        found = frame.select("i", "a", "b", F.explode(F.expr(_candidates("text"))).alias("c")).select("i", "a", "b", "c.*").orderBy("i", "kind", "s").collect()
        x = np.array([[r[f] for f in FEATURES] for r in found], dtype=float)
        # A candidate is right if it is the planted span, give or take white space at its ends.
        y = np.array([r["a"] >= 0 and abs(r["s"] - r["a"]) <= 1 and abs(r["e"] - r["b"]) <= 1 for r in found], dtype=float)
        kind = np.array([r["kind"] for r in found])
        apart = np.array([r["i"] % 4 == 0 for r in found])
        model = Boosted(trees=40, depth=3, rate=0.3, bins=24).fit(x[~apart], y[~apart])
        least = {}
        for k in KINDS:
            own = apart & (kind == k)
            margin = model.margin(x[own])
            least[k] = Isotonic().fit(margin, y[own]).least(precision) if len(margin) else float("inf")
        _models[key] = (model.sql([f"c.{f}" for f in FEATURES]), least)
    return _models[key]


def find_spans(df: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """df with two arrays of (kind, s, e): the base spans and all spans, by kind (email, ip, card, phone, ssn, iban) and start."""
    df = df.select(*[c for c in df.columns if c == text or c not in (base, spans, "__b", "__x", "__text")])
    margin, least = fit(df.sparkSession)
    found = ", ".join(f"transform(filter({_spans('__text', BASE[k], NEEDS[k], k)}, x -> {_BASE_TEST[k]}), x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))" for k in BASE)
    out = df.withColumn("__text", F.coalesce(df[text], F.lit("")))
    out = out.withColumn("__b", F.expr(f"concat({found})"))
    above = " ".join(f"WHEN '{k}' THEN {v:.9e}D" for k, v in least.items() if np.isfinite(v))
    scored = f"transform({_candidates('__text')}, c -> named_struct('s', c.s, 'e', c.e, 'kind', c.kind, 'above', ({margin}) - (CASE c.kind {above} END)))"
    chosen = f"filter({scored}, c -> c.above >= 0 AND NOT exists(__b, b -> b.s < c.e AND c.s < b.e))"
    sorted_ = f"array_sort({chosen}, (p, q) -> CASE WHEN p.s <> q.s THEN p.s - q.s ELSE q.e - p.e END)"
    # One candidate waits until the next one does not overlap it; of two that overlap the one further above its threshold waits on.
    none = "named_struct('s', 0, 'e', 0, 'kind', '', 'above', -1D)"
    plain = "named_struct('kind', {0}.kind, 's', {0}.s, 'e', {0}.e)"
    kept = f"""aggregate({sorted_}, named_struct('w', {none}, 'o', CAST(array() AS ARRAY<STRUCT<kind: STRING, s: INT, e: INT>>)),
        (a, c) -> IF(c.s >= a.w.e, named_struct('w', c, 'o', IF(a.w.e > 0, concat(a.o, array({plain.format('a.w')})), a.o)), IF(c.above > a.w.above, named_struct('w', c, 'o', a.o), a)),
        a -> IF(a.w.e > 0, concat(a.o, array({plain.format('a.w')})), a.o))"""
    gate = F.expr(" OR ".join(f"__text RLIKE {_quote(needs)}" for needs in dict.fromkeys(v[1] for v in GENERATORS.values())))
    out = out.withColumn("__x", F.when(gate, F.expr(kept)).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, s: INT, e: INT>>)")))
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    rank = lambda v: f"CASE {v}.kind {order} END"
    both = f"IF(size(__x) = 0, __b, array_sort(concat(__b, __x), (p, q) -> CASE WHEN p.kind <> q.kind THEN ({rank('p')}) - ({rank('q')}) ELSE p.s - q.s END))"
    return out.withColumn(spans, F.expr(both)).withColumnRenamed("__b", base).drop("__x", "__text")


def joined(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span of its text replaced by its kind in brackets (overlapping spans by that of the first); null stays null."""
    found = find_spans(df, text, "__base", "__spans")
    ordered = "array_sort(__spans, (p, q) -> CASE WHEN p.s <> q.s THEN p.s - q.s ELSE q.e - p.e END)"
    body = f"""aggregate({ordered}, named_struct('p', 0, 'o', CAST(array() AS ARRAY<STRING>)),
        (a, x) -> IF(x.s >= a.p, named_struct('p', x.e, 'o', concat(a.o, array(substring({text}, a.p + 1, x.s - a.p), concat('[', upper(x.kind), ']')))), named_struct('p', greatest(a.p, x.e), 'o', a.o)),
        a -> concat(array_join(a.o, ''), substring({text}, a.p + 1)))"""
    new = F.when(F.size("__spans") > 0, F.expr(body)).otherwise(F.col(text))
    return found.withColumn(text, new).drop("__base", "__spans")


def digest(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns, counts of base spans, base_sha256 and all spans as one string."""
    found = find_spans(df.select(*keep, F.col(text).alias("__doc")), "__doc", "__base", "__all")
    count = lambda k: F.expr(f"CAST(size(filter(__base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}")
    return found.select(*keep, *[count(k) for k in BASE], F.sha2(joined("__base"), 256).alias("base_sha256"), joined("__all").alias("spans"))
