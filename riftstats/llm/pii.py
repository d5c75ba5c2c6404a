"""Personal data spans with DataFrame functions only.

Per kind a regular expression proposes leftmost non-overlapping spans, a
validator confirms them (value ranges, Luhn, mod-97, digit counts, entropy) and
words within CONTEXT_CHARS before and after the span adjust its score: words of
the kind raise it, words of examples and checksums lower it. `split` and
`regexp_extract_all` by the same expression give the gaps and the matches in
turn, so offsets are running sums of lengths and no Python is needed. The
patterns are possessive and anchored to the start of a run, so a very long run
of letters or digits is read once.

The four base kinds (email, ip, card, phone) are kept whatever their score. Others
are added and kept only from MIN_SCORE on: `iban` (mod-97 confirmed), `phone_local`
(no plus sign; needs a context word), `secret` (a run of 20 or more characters of
keys, with letters and digits and the entropy of a random string; needs a context
word), `token` (three dotted base64url parts, of which the first decodes to a JSON
object), `key` (a prefix that issuers of keys use, and the entropy of a random
string) and `assigned` (a value behind a word such as `password` and = or :, in
quotes or with a digit).

Cases: a null, empty or clean text has no spans and the counts 0; a text of any
length is read whole (offsets are summed, never cut out of the text again); the digest of
no spans is that of the empty string; repeated rows give repeated results; null
ids are carried; an empty table gives an empty result; other columns pass
through `find` untouched unless they are named as its outputs, which it replaces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import free_name

#: Names of values that aren't for others, and the kinds in their
#: order with the pattern of each.
NAMES = r"(?:password|passwd|passphrase|pwd|secret|(?:api|access|secret|private)[_-]?key|(?:auth|access|api)[_-]?token)"
LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "phone_local": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+",
    "token": r"e(?<![A-Za-z0-9_.-]e)[A-Za-z0-9_-]{7,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?!\.?[A-Za-z0-9_-])",
    "key": r"(?<![A-Za-z0-9_-])(?:gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|sk-|[sprw]k_live_|[sprw]k_test_|hf_|npm_|pypi-|AKIA|ASIA|AIza|SG\.)[A-Za-z0-9_.-]{14,}+",
    "assigned": rf"""(?i)(?<=[=:\s"'])(?:(?<=(?<![A-Za-z0-9]){NAMES}["']?\s{{0,3}}[:=]\s{{0,3}}["'])[^"'\s]{{5,}}+(?=["'])|(?<=(?<![A-Za-z0-9]){NAMES}["']?\s{{0,3}}[:=]\s{{0,3}})(?=[^\s"',;0-9]*+[0-9])[^\s"',;]{{6,}}+)""",
}
#: Texts of which every match of a kind has one before it, in lower
#: case; they are looked for first where the pattern is slow.
NEEDS = {"assigned": ["passw", "passphrase", "pwd", "secret", "key", "token"]}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed proposal alone, and what a context word adds.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "phone_local": 0.3, "secret": 0.3, "token": 0.8, "key": 0.8, "assigned": 0.7}
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(ip|host|server|address|login)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(iban|account|bank|transfer)\b",
    "phone_local": r"(?i)\b(phone|tel|call|mobile|fax)\b",
    "secret": r"(?i)(\b|_)(token|secret|key|api_?key|password|passwd|pwd|bearer|credentials?|authorization)\b",
    "token": r"(?i)\b(token|jwt|bearer|authorization)\b",
    "key": r"(?i)(\b|_)(token|secret|key|bearer|credentials?)\b",
    "assigned": r"(?i)\b(login|user(name)?|account|credentials?)\b",
}
#: Not within an address such as "a@mail.example.com".
DOUBT = r"(?i)(?<![\w.@-])(example|sample|dummy|placeholder|commit|checksum|digest|md5|sha[0-9]*)(?![\w@-]|\.\w)"
CONTEXT_BONUS, DOUBT_MALUS, CONTEXT_CHARS, MIN_SCORE = 0.3, 0.2, 40, 0.5
#: Least bits a character of a secret.
SECRET_ENTROPY = 2.8
#: Proposals whose offsets are summed up together.
CHUNK = 256
#: Code points of a block of the text that is redacted.
BLOCK = 512
MOST_NEAR = CONTEXT_CHARS // 5


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes the mod-97 check."""
    flat = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4)), "")
    step = lambda a, c: F.when(c == "", a).when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def entropy(c: Column) -> Column:
    """Bits a character, from the counts of the distinct characters."""
    n = F.length(c)
    bits = lambda a, x: a - F.when(x == "", 0.0).otherwise((share := (n - F.length(F.replace(c, x, F.lit("")))) / n) * F.log2(share))
    return F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), bits)


def confirmed(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        plain = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "token":
        head = F.translate(F.substring_index(match, ".", 1), "-_", "+/")
        json = F.try_to_binary(F.rpad(head, F.ceil(F.length(head) / 4) * 4, F.lit("=")), F.lit("base64")).cast("string")
        return json.startswith("{") & F.get_json_object(json, "$").isNotNull()
    if kind == "key":
        return entropy(match) >= SECRET_ENTROPY
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (entropy(match) >= SECRET_ENTROPY)
    return F.lit(True)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, even where body uses it within
    a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of the confirmed spans; start
    counts code points from 0, end is exclusive. Offsets are summed up within
    chunks of CHUNK proposals and then over the chunks, so that a text with very
    many spans doesn't copy its list again for each. Every match has five
    characters at least, so the next MOST_NEAR gaps and matches hold the context
    behind it."""
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    gaps = F.split(text, PATTERNS[kind], -1)
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + F.length(x["gap"])
        near = F.concat(x["before"], F.lit(" "), x["after"])
        score = F.lit(START[kind]) + F.when(near.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0) - F.when(near.rlike(DOUBT), DOUBT_MALUS).otherwise(0.0)
        score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 2)
        ok = F.coalesce(confirmed(kind, x["match"]), F.lit(False))
        if kind not in BASE:
            ok = ok & (score >= MIN_SCORE)
        one = F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(x["match"])).alias("end"), score.alias("score"))
        return F.struct((at + F.coalesce(F.length(x["match"]), F.lit(0))).alias("at"), F.when(x["match"].isNotNull() & ok, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    def with_context(pairs: Column) -> Column:
        last, first = (lambda c: F.right(c, F.lit(CONTEXT_CHARS))), (lambda c: F.left(c, F.lit(CONTEXT_CHARS)))
        match = lambda x: F.coalesce(x["match"], F.lit(""))

        def one(x: Column, i: Column) -> Column:
            lo = F.greatest(F.lit(0), i - MOST_NEAR)
            before = F.array_join(F.transform(F.slice(pairs, lo + 1, i - lo), lambda y: F.concat(last(y["gap"]), last(match(y)))), "")
            after = F.array_join(F.transform(F.slice(pairs, i + 2, F.lit(MOST_NEAR)), lambda y: F.concat(first(y["gap"]), first(match(y)))), "")
            return F.struct(x["gap"], x["match"], last(F.concat(before, last(x["gap"]))).alias("before"), first(after).alias("after"))

        return F.transform(pairs, one)

    def chunk(pairs: Column, c: Column) -> Column:
        return F.aggregate(F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    def shifted(chunks: Column) -> Column:
        starts = F.aggregate(chunks, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c["at"])))
        move = lambda s, by: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["score"].alias("score"))
        return bound(starts, lambda by: F.flatten(F.transform(chunks, lambda c, i: F.transform(c["out"], lambda s: move(s, F.get(by, i))))))

    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    pairs = bound(pairs, with_context)
    chunks = bound(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / CHUNK).cast("int") - 1), lambda c: chunk(p, c)))
    some = text.rlike(PATTERNS[kind])
    if kind in NEEDS:
        some = reduce(or_, (F.lower(text).contains(x) for x in NEEDS[kind])) & some
    return F.when(some, bound(chunks, shifted)).otherwise(empty)


def find(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Adds `out`: array<struct<kind, start, end, score>> in the order of
    the kinds, then of start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out, F.concat(*[spans_of(text, k) for k in PATTERNS]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores")
    added = [count(k) for k in PATTERNS if k not in BASE]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), *added, F.size("pii").cast("long").alias("n_spans"), scores)


def pieces(text: Column, spans: Column) -> Column:
    """array<string>: the text between spans and <KIND> for each, in turn; spans that
    overlap become one, named by the first. The text is cut into blocks of BLOCK code
    points once, so that a span costs its gap and a block, not the text before it;
    the places reached are carried within chunks of CHUNK spans and then over the
    chunks."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast("array<string>")

    def between(blocks: Column, lo: Column, hi: Column) -> Column:
        i, j = F.floor(lo / BLOCK).cast("int"), F.floor(hi / BLOCK).cast("int")
        first, last = F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, j), F.lit(""))
        across = F.concat(F.substring(first, lo - i * BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.substring(last, F.lit(1), hi - j * BLOCK))
        return F.when(i == j, F.substring(first, lo - i * BLOCK + 1, hi - lo)).otherwise(across)

    def chunk(blocks: Column, part: Column, at: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            fresh = s["start"] >= a["at"]
            more = F.array(between(blocks, a["at"], s["start"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], more)).otherwise(a["out"]).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def whole(blocks: Column) -> Column:
        def cut(spans: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(spans) / CHUNK).cast("int") - 1), lambda c: F.slice(spans, c * CHUNK + 1, F.lit(CHUNK)))
            return bound(parts, over)

        def over(parts: Column) -> Column:
            reached = F.aggregate(parts, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.greatest(F.element_at(a, -1), F.array_max(F.transform(p, lambda s: s["end"]))))))
            made = lambda at: F.flatten(F.transform(parts, lambda p, i: chunk(blocks, p, F.get(at, i))))
            return bound(reached, lambda at: F.concat(made(at), F.array(between(blocks, F.element_at(at, -1), F.length(text)))))

        return bound(ordered, cut)

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), whole)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by <KIND>; spans that overlap
    become one, named by the first. A text without spans is left as it is, and so
    is every other column, whatever its name."""
    kept, spans = docs.columns, free_name(docs, "pii")
    found, text = find(docs, text_col, spans), F.col(text_col)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, F.array_join(pieces(text, F.col(spans)), "")).otherwise(text)).select(*kept)
