"""Personal data by weak supervision; DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed rules and always stay.  Regular expressions, gazetteers and announcing words
propose further candidates of these kinds (obfuscated addresses, local numbers, card-like numbers) and of two more
(secret, name).  Every candidate, base spans included, gets the votes of five labelers of its kind: two on its form, a
gazetteer, the words before it, and its borders.  Expectation maximisation over the counts of vote patterns estimates
each labeler's hits and false alarms, and its posteriors train a logistic span classifier for each kind, which looks at
the span (length, digits, capitals, variety, separators, what precedes it) and decides on the candidates that
are no base spans.  Patterns are few whatever the input, so the driver holds a table of bounded size.

The expressions are possessive and never restart inside a run, so they take linear time and no stack on long texts.
``\\G`` lets a match start right after the one before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "name")
# The contract's patterns, written so that they don't backtrack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
# Prefixes of issued keys, common given names, ends of host names, first digits of card issuers, words that announce.
KEY_PREFIXES = ("sk-", "pk-", "ghp_", "gho_", "AKIA", "ASIA", "xoxb-", "xoxp-", "eyJ", "AIza", "glpat-")
GIVEN_NAMES = (
    "Alice", "Andrea", "Anna", "Anne", "Antonio", "Barbara", "Bob", "Carlos", "Carmen", "Carol", "Charles", "Christian", "Claudia", "Daniel", "David", "Diego",
    "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Fernando", "Francisco", "Frank", "François", "Gabriel", "George", "Hans", "Helen", "Isabel", "James", "Jan",
    "Javier", "Jean", "Jennifer", "Jessica", "Johann", "John", "Jorge", "Jose", "José", "Joseph", "Juan", "Julia", "Jürgen", "Karen", "Karl", "Kevin",
    "Laura", "Linda", "Lisa", "Louis", "Lucia", "Luis", "Manuel", "Marco", "Maria", "María", "Marie", "Mark", "Martin", "Mary", "Matthew", "Michael",
    "Miguel", "Monica", "Nicolas", "Olivia", "Pablo", "Patricia", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Rachel", "René", "Robert", "Sandra", "Sarah",
    "Sofia", "Sophie", "Stefan", "Stephen", "Susan", "Teresa", "Thomas", "Ursula", "Victor", "William", "Wolfgang", "Yvonne",
)
HOST_ENDS = "com|org|net|edu|gov|io|info|biz|eu|de|at|ch|fr|es|it|nl|be|pt|pl|se|uk|ie|us|ca|mx|br|ar|au|nz|jp|cn|in"
CARD_ISSUERS = "4|5[1-5]|2[2-7]|3[47]|35|30[0-5]|36|38|6011|64[4-9]|65"
TITLES = "Mr|Mrs|Ms|Dr|Prof"
_LISTED = "(?:" + "|".join(GIVEN_NAMES) + ")"
_ANNOUNCED = rf"(?<=\b(?:{TITLES})\.?\x20|\b(?:name is|[Nn]ame|[Dd]ear|[Cc]ontact|[Ss]igned|[Ss]igned by):?\x20)"
_CAPITAL = r"\p{Lu}\p{Ll}++"
_AT, _DOT = r"(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20)", r"(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)"
#: What is proposed besides the base patterns' matches.
PROPOSALS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{2,64}}+{_AT}(?=[0-9-]*+[A-Za-z])[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+)++(?!@)",
    "phone": r"(?=[(0-9])(?<![0-9+A-Za-z.(/-])(?<!\+[0-9]{1,3}\x20?)(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
    "name": rf"(?=\p{{Lu}}\p{{Ll}})(?<!\p{{L}})(?!(?:{TITLES}|Dear|Contact|Signed|Name)\b)(?:{_ANNOUNCED}{_CAPITAL}(?:\x20{_CAPITAL})?|{_CAPITAL}\x20(?!{_LISTED}\x20\p{{Lu}}){_CAPITAL})(?!\p{{L}})",
}
#: What a text must hold for a proposal.
MENTIONS = {"email": r"[(\[]at[)\]]|\x20at\x20[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]|\x20dot\x20|\x20?[(\[]dot[)\]])", "phone": "[0-9]{3}[\\x20.-][0-9]{3}"}
#: Code points before and after a candidate, back to the match before and up to the next, that labelers read.
BEFORE_CHARS, AFTER_CHARS = 32, 2
#: Labelers by kind: two on the value's form, a gazetteer on the value, words before, borders (before, after).
LABELERS = {
    "email": (
        r"^[A-Za-z0-9._%+-]++(?:@|[^@]*[(\[]at[)\]])", r"^[A-Za-z][A-Za-z0-9._%+-]{2,}", rf"(?i)(?:\.|dot[)\]]?\x20?)(?:{HOST_ENDS})$",
        r"(?i)(?:e-?mail|mail|contact|write|reach|address|from|to|cc)\W*$", (r"(?:^|[\s<(\[\"':;,|])$", r"^(?:$|[\s>)\]\"':;,.!?|])"),
    ),
    "ip": (
        r"^(?:(?:0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$", r"(?:^|\.)(?:[2-9][0-9]|[12][0-9]{2})(?:\.|$)", r"^(?:10|127|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|[1-9][0-9]|1[0-9][0-9]|2[01][0-9])\.",
        r"(?i)(?:\bip(?:v4)?|address|host|server|client|from|login|gateway|dns)\W*$", (r"(?:^|[\s<(\[\"':;,=|/@])$", r"^(?:$|[\s>)\]\"':;,!?|/]|\.(?:\s|$))"),
    ),
    "card": (
        r"^(?:[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{15,16}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$", None, rf"^(?:{CARD_ISSUERS})",
        r"(?i)(?:card|visa|master|amex|credit|debit|payment|pan|cc)\W*(?:no|number|nr)?\W*$", (r"(?:^|[\s<(\[\"':;,=|#])$", r"^(?:$|[\s>)\]\"':;,.!?|])"),
    ),
    "phone": (
        r"^(?:\+[0-9]|\([0-9]{2,4}\)|0[0-9]+\x20|[0-9]{3}-[0-9]{3}-[0-9]{4}$)", r"[0-9]{3,4}[\x20-][0-9]{3,4}$", r"^\+?(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])?\x20?\(?(?:0?[0-9]{2,3})\)?[\x20.-]",
        r"(?i)(?:phone|\btel|call|fax|mobile|cell|dial|whatsapp|sms|number)\W*$", (r"(?:^|[\s<(\[\"':;,=|])(?<!\b(?:v|ver|version|build|part|order|id)\W{1,2})$", r"^(?:$|[\s>)\]\"':;,.!?|])"),
    ),
    "secret": (
        r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]{20,})$", r"(?:[0-9][A-Za-z]|[A-Za-z][0-9]).*(?:[0-9][A-Za-z]|[A-Za-z][0-9]).*(?:[0-9][A-Za-z]|[A-Za-z][0-9])", "^(?:" + "|".join(KEY_PREFIXES) + ")",
        r"(?i)(?:token|secret|passwo?r?d|passwd|api[_-]?key|access[_-]?key|bearer|credential)[\"']?\s*(?:[=:]|is)?\s*[\"']?$", (r"[=:\"'(\s]$", r"^[\"';,)\s]|^$"),
    ),
    "name": (
        r"^\p{Lu}\p{Ll}{2,}\x20\p{Lu}\p{Ll}{2,}$", r"\x20\p{Lu}\p{Ll}{3,}$", rf"^{_LISTED}(?:\x20|$)",
        rf"(?:\b(?:{TITLES})\.?|(?i:\bname(?:\s+is)?|\bdear|\bcontact|\bsigned(?:\s+by)?))\s*:?\s*$", (r"(?:[a-z,:;(\"']\x20?|\x20)$", r"^(?:$|[\s.,;:!?)\"'])"),
    ),
}
VOTES = ("form", "detail", "listed", "context", "borders")
#: What is taken of a labeler before any data: votes on true spans and on others; and the share of true spans by kind.
FIRST_HITS = {"card": (0.9, 0.97, 0.9, 0.3, 0.9), "": (0.9, 0.8, 0.5, 0.3, 0.9)}
FIRST_FALSE = {"card": (0.6, 0.1, 0.4, 0.03, 0.7), "name": (0.6, 0.6, 0.01, 0.01, 0.7), "": (0.4, 0.4, 0.1, 0.03, 0.6)}
FIRST_SHARE = {"email": 0.5, "ip": 0.5, "card": 0.3, "phone": 0.5, "secret": 0.2, "name": 0.05}
LOOKS = ("is_long", "is_longer", "some_digits", "digits", "capitals", "varied", "parted", "set_off")
#: Places in VOTES that the classifier sees, too.
FEATURE_VOTES = (1, 2, 3, 4)
EM_ROUNDS, FIT_ROUNDS, FIT_RATE, LEAST_WEIGHT = 60, 600, 1.0, 1e-3
ACCEPT = 0.5


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _located(found: str, pieces: str) -> Column:
    """Array of (s, e, value, before, after) in code points of the matches in column ``found``.

    The pieces between matches and the matches, end to end, are the text, so places are running sums of lengths.
    """
    n = F.greatest(F.size(found), F.lit(1))
    lengths = F.zip_with(F.col(found), F.slice(pieces, 1, n), lambda f, p: F.struct(F.length(p).alias("gap"), F.length(f).alias("own")))
    # The sums gather in a string: adding to an array would copy all its elements for every match.
    starts = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["own"]).alias("at"), F.concat(a["out"], F.lit(","), (a["at"] + x["gap"]).cast("string")).alias("out")),
        lambda a: F.split(F.substring(a["out"], 2, 2**31 - 1), ","),
    )
    around = F.zip_with(F.slice(pieces, 1, n), F.slice(pieces, 2, n), lambda p, q: F.struct(F.right(p, F.lit(BEFORE_CHARS)).alias("before"), F.left(q, F.lit(AFTER_CHARS)).alias("after")))
    spans = F.zip_with(F.col(found), starts, lambda f, s: F.struct(s.cast("int").alias("s"), (s.cast("int") + F.length(f)).alias("e"), f.alias("value")))
    spans = F.zip_with(spans, around, lambda x, y: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value"), y["before"].alias("before"), y["after"].alias("after")))
    return F.when(F.size(found) > 0, spans).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,value:string,before:string,after:string>>)"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 16) & (n <= 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _votes(kind: str, x: Column) -> Column:
    """The labelers' votes as bits, in the order of VOTES."""
    form, detail, listed, context, (left, right) = LABELERS[kind]
    value = _digits(x["value"]) if kind == "card" else x["value"]
    votes = [x["value"].rlike(form), luhn(value) if detail is None else x["value"].rlike(detail), value.rlike(listed), x["before"].rlike(context), x["before"].rlike(left) & x["after"].rlike(right)]
    return sum((F.shiftleft(v.cast("int"), i) for i, v in enumerate(votes[1:], 1)), votes[0].cast("int"))


def _look(x: Column) -> Column:
    """The features of LOOKS as bits."""
    n, digits = F.length(x["value"]), F.length(_digits(x["value"]))
    looks = [n >= 20, n >= 32, digits * 10 >= n * 3, digits * 10 >= n * 8, x["value"].rlike(r"\p{Lu}"), F.size(F.array_distinct(F.split(x["value"], ""))) >= 10, x["value"].rlike(r"[\x20.()-]"), x["before"].rlike(r"[=:<(\"'|]\s?$")]
    return sum((F.shiftleft(v.cast("int"), i) for i, v in enumerate(looks[1:], 1)), looks[0].cast("int"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, one array (s, e) for each base kind, and ``extra``: all candidates with their votes and looks.

    ``extra`` has kind, s, e, base (whether it is a base span), votes and look, bits as in VOTES and LOOKS.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"))
    every = {**{f"base_{k}": p for k, p in PATTERNS.items()}, **{f"more_{k}": p for k, p in PROPOSALS.items()}}
    none = F.expr("cast(array() as array<string>)")

    def found(name: str, pattern: str) -> Column:
        how, kind = name.split("_")
        matches = _matches(F.col("_text"), pattern)
        if how == "base":
            return F.when(F.contains("_text", F.lit(NEEDS[kind])), matches).otherwise(none) if NEEDS[kind] else matches
        return F.when(F.col("_text").rlike(MENTIONS[kind]), matches).otherwise(none) if kind in MENTIONS else matches

    rows = rows.select("*", *[found(k, p).alias(f"_f_{k}") for k, p in every.items()])
    rows = rows.select("*", *[F.when(F.size(f"_f_{k}") > 0, F.split("_text", p, -1)).otherwise(none).alias(f"_p_{k}") for k, p in every.items()])
    rows = rows.select("doc_id", *[_located(f"_f_{k}", f"_p_{k}").alias(f"_l_{k}") for k in every])

    def kept(kind: str) -> Column:
        spans = F.filter(f"_l_base_{kind}", lambda x: _valid(kind, x["value"]))
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(kind)

    def voted(kind: str, how: str) -> Column:
        def one(x: Column) -> Column:
            base = _valid(kind, x["value"]) if how == "base" else F.lit(False)
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.coalesce(base, F.lit(False)).alias("base"), _votes(kind, x).alias("votes"), _look(x).alias("look"))

        spans: Column | str = f"_l_{how}_{kind}"
        if (how, kind) == ("base", "card"):
            spans = F.filter(spans, lambda x: F.length(_digits(x["value"])).between(13, 19))
        return F.transform(spans, one)

    return rows.select("doc_id", *[kept(k) for k in KINDS], F.concat(*[voted(k.split("_")[1], k.split("_")[0]) for k in every]).alias("extra"))


Pattern = tuple[str, int, int]  # kind, votes, look


def _bits(x: int, n: int) -> list[float]:
    return [float(x >> i & 1) for i in range(n)]


def reliabilities(counts: dict[int, int], kind: str, rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray, np.ndarray, dict[int, float]]:
    """Share of true spans, each labeler's hits and false alarms, and each vote pattern's posterior, for one kind.

    Two classes, labelers independent given the class.  What is taken before the data weighs as much as the data, which
    holds the classes in their places, also where all candidates have one pattern.
    """
    patterns = sorted(counts)
    votes = np.array([_bits(p, len(VOTES)) for p in patterns]).reshape(-1, len(VOTES))
    n = np.array([counts[p] for p in patterns], float)
    first_hit, first_false = (np.array(x.get(kind, x[""])) for x in (FIRST_HITS, FIRST_FALSE))
    share, hit, false = FIRST_SHARE[kind], first_hit, first_false
    belief = max(20.0, float(n.sum()))
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        yes = share * np.prod(np.where(votes > 0, hit, 1 - hit), axis=1)
        no = (1 - share) * np.prod(np.where(votes > 0, false, 1 - false), axis=1)
        post = yes / (yes + no)
        true, other = n * post, n * (1 - post)
        share = (true.sum() + belief * FIRST_SHARE[kind]) / (n.sum() + belief)
        hit = (true @ votes + belief * share * first_hit) / (true.sum() + belief * share)
        false = (other @ votes + belief * (1 - share) * first_false) / (other.sum() + belief * (1 - share))
    return float(share), hit, false, dict(zip(patterns, post.tolist()))


def _features(votes: int, look: int) -> list[float]:
    """A constant, what the span looks like, its detail (a card's checksum), and whether it is listed, announced and bordered."""
    return [1.0, *_bits(look, len(LOOKS)), *(float(votes >> i & 1) for i in FEATURE_VOTES)]


def span_classifiers(counts: dict[Pattern, int]) -> dict[str, list[float]]:
    """For each kind weights of a logistic classifier over _features(), fitted to the posteriors by gradient descent."""
    out = {}
    for kind in sorted({p[0] for p in counts}):
        own = {p[1:]: n for p, n in counts.items() if p[0] == kind}
        by_votes: dict[int, int] = {}
        for (votes, _), k in own.items():
            by_votes[votes] = by_votes.get(votes, 0) + k
        post = reliabilities(by_votes, kind)[3]
        x = np.array([_features(*p) for p in own])
        y = np.array([post[votes] for votes, _ in own])
        n = np.array(list(own.values()), float) / sum(own.values())
        w = np.zeros(x.shape[1])
        for _ in range(FIT_ROUNDS):
            w -= FIT_RATE * (((1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) * n) @ x + LEAST_WEIGHT * w)
        out[kind] = w.tolist()
    return out


def pattern_counts(found: DataFrame) -> dict[Pattern, int]:
    """How often each vote pattern and look occurs among candidates(): 6 kinds * 2**5 votes * 2**8 looks at most."""
    names = ("kind", "votes", "look")
    grouped = found.select(F.explode("extra").alias("x")).groupBy(*[F.col(f"x.{n}").alias(n) for n in names]).count()
    return {tuple(r[n] for n in names): int(r["count"]) for r in grouped.collect()}


def find_pii(docs: DataFrame, weights: dict[str, list[float]] | None = None) -> DataFrame:
    """doc_id, arrays email, ip, card, phone of (s, e), and accepted: (kind, s, e, score) of further spans.

    Places are code points, ends exclusive; a null text counts as empty.  Matches are leftmost and do not overlap
    within a kind and pattern; those that fail a rule are dropped and not tried again.  Row by row: repeated rows stay, no
    rows give no rows, and only doc_id and text are read.  ``weights`` of span_classifiers() may come from other
    documents; without them they are learnt from ``docs``, which need no labels.  A kind without weights has no further spans.
    """
    found = materialize(candidates(docs), "pii")
    if weights is None:
        weights = span_classifiers(pattern_counts(found))

    def score(x: Column) -> Column:
        raw = F.lit(-30.0)
        for kind, w in weights.items():
            bits = [F.getbit(x["look"], F.lit(i)) for i in range(len(LOOKS))] + [F.getbit(x["votes"], F.lit(i)) for i in FEATURE_VOTES]
            raw = F.when(x["kind"] == kind, sum((F.lit(v) * b.cast("double") for v, b in zip(w[1:], bits)), F.lit(w[0]))).otherwise(raw)
        return 1 / (1 + F.exp(-raw))

    scored = F.transform(F.filter("extra", lambda x: ~x["base"]), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), score(x).alias("score")))
    return found.select("doc_id", *KINDS, F.filter(scored, lambda x: x["score"] >= ACCEPT).alias("accepted"))


def span_text(accepted: bool) -> Column:
    """All spans as kind:start:end, by kind, then start, comma-joined; of equal spans one."""

    def of(kind: str) -> Column:
        base = F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) if kind in KINDS else None
        more = F.transform(F.filter("accepted", lambda x: x["kind"] == kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        return F.array_sort(more) if base is None else F.when(F.size(more) > 0, F.array_sort(F.array_union(base, more))).otherwise(base)

    if not accepted:
        return F.array_join(F.concat(*[_joined(k, F.col(k)) for k in KINDS]), ",")
    return F.array_join(F.concat(*[_joined(k, of(k)) for k in KINDS + EXTRA_KINDS]), ",")
