"""Secret scans: pattern spans, and spans of high sliding-window entropy (operator 8). DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remembra.llm._store import quoted

# The patterns of the base kinds, in their order. A run that is too short for access or hex holds no
# other match of the kind, so their least lengths stand in the patterns; an assignment's value is measured afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates of the entropy rule: whole runs of these characters; shorter ones than the window are none.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of the sliding window.
WINDOW = 20
#: Character classes, the first that holds decides: pattern of the whole candidate, and least entropy in bits of some window.
CLASSES = (
    (r"^[0-9]+$", None),
    (r"^[0-9a-fA-F]+$", 3.0),
    (r"^[a-z0-9]+$", 3.5),
    (r"^[A-Z0-9]+$", 3.5),
    (r"^[A-Za-z0-9]+$", 3.6),
    (r"^[A-Za-z0-9+/_=-]+$", 3.7),
)
#: A piece of a candidate needs this many digits and letters; prose and plain numbers have not both.
LEAST = r"(?:[0-9][^0-9]*+){3}", r"(?:[A-Za-z][^A-Za-z]*+){3}"
#: Or a window has this many capitals and small letters, so much entropy, and so many runs of one class a
#: character: random keys change class often, names of joined words seldom.
MIXED, MIXED_BITS, MIXED_RUNS = 3, 3.7, 0.4
#: Words of placeholders: they allow a whole candidate of up to ALLOWED_LENGTH characters.
PLACEHOLDER, ALLOWED_LENGTH = r"(?i)example|placeholder|changeme|your[_-]|xxxx|dummy|0123456789|abcdefgh", 64
#: Allow-list: placeholders, UUIDs, dates, paths or joined words, and what stands before published digests. A hit cancels
#: the windows that it touches, so that one that arises by chance in a long secret does not hide the rest. Possessive, so a
#: candidate of any length is gone through without recursion, and each run of letters once.
ALLOWED = PLACEHOLDER + r"|^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$|[0-9]{4}-[0-9]{2}-[0-9]{2}|(?<![a-z])(?:[a-z]{2,}+[/_=-]){3,}+[a-z]*+|(?:[/_=-][a-z]{2,}+){3,}+|([0-9a-z]{1,4})\1{4}"
ALLOWED_BEFORE = r"(?i)(?:sha-?[0-9]{1,3}|md5|commit|checksum|digest|integrity|etag|uuid)[\x20\"'(]*[-:=]?[\x20\"'(]*$"
#: What a published digest looks like: hexadecimal, or base64 of 16, 20, 32, 48 or 64 bytes. Other values after those words are no digests.
DIGEST = r"^(?:sha-?[0-9]{1,3}[-=])?(?:[0-9a-fA-F-]{20,128}|[A-Za-z0-9+/]{22}==|[A-Za-z0-9+/]{27}=|[A-Za-z0-9+/]{43}=|[A-Za-z0-9+/]{64}|[A-Za-z0-9+/]{86}==)$"
#: Host and path of a URL are no place for entropy candidates, whatever their length; its user part, query and fragment are.
URL = r"(?:(?i:https?)://|@(?=[A-Za-z0-9-]*+\.))[A-Za-z0-9.-]++(?::[0-9]{1,5}+(?=/))?+(?:/[^\s\"'<>?#]*+|(?![@:%_+=~!$&]))"


#: Items that one step of _scan takes, and code points of a piece in _chunks.
GROUP, CHUNK = 256, 4096


def _scan(items: Column, state: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """For each item, emit(state before, state after, item), an array of `kind`, with step(state, item) the next state.

    Arrays grow by copies, so they are grown within groups, and then the groups' arrays are joined: the work is in proportion to the items,
    but for the 256th part of their square's copies of references.
    """
    groups = F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / GROUP).cast("int")), lambda g: F.slice(items, (g * GROUP + 1).cast("int"), F.lit(GROUP)))
    none = F.expr(f"cast(array() as array<{kind}>)")

    def one(acc: Column, x: Column) -> Column:
        after = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], after, x))).alias("out"))

    def group(acc: Column, g: Column) -> Column:
        inner = F.aggregate(g, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return F.struct(inner["state"].alias("state"), F.concat(acc["outs"], F.array(inner["out"])).alias("outs"))

    start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("outs"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(groups, start, group, lambda acc: acc["outs"]))).otherwise(none)


MATCH = "struct<s:int,e:int,m:string,b:string>"


def _matches(text: Column, pattern: str, before: int) -> Column:
    """array of MATCH: start, end (exclusive), match, and up to `before` characters before it, in code points.

    split() and regexp_extract_all() find the same matches, so lengths add up to places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.struct(F.length(p).alias("n"), F.right(p, F.lit(before)).alias("b"), m.alias("m")))
    both = F.filter(both, lambda x: x["m"].isNotNull())
    step = lambda at, x: at + x["n"] + F.length(x["m"])
    return _scan(both, F.lit(0), step, lambda _, at, x: F.struct((at - F.length(x["m"])).alias("s"), at.alias("e"), x["m"].alias("m"), x["b"].alias("b")), MATCH)


def _term(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


#: Counts of a window's characters, five bits each, twelve in a number; a character's place is its code's distance from the first.
PER_NUMBER, NUMBERS, FIRST = 12, 7, ord("+")


def _windows(s: Column, window: int = WINDOW) -> Column:
    """struct<best, mixed>: the largest Shannon entropy, in bits a character, of any `window` characters of s (of s, if shorter),
    and of any that changes class often and has capitals and small letters (0 if none).

    One pass along s. It carries the counts of the window's characters, the sum of c * log2(c) over them, and the counts of
    capitals, small letters and class changes; the character that comes in and the one that goes out each change them by one.
    window is less than 32, s of the characters of CANDIDATE.
    """
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c) - FIRST)
    upper = lambda c: c.between(ord("A") - FIRST, ord("Z") - FIRST)
    lower = lambda c: c.between(ord("a") - FIRST, ord("z") - FIRST)
    digit = lambda c: c.between(ord("0") - FIRST, ord("9") - FIRST)
    kind = lambda c: F.when(upper(c), 1).when(lower(c), 2).when(digit(c), 3).otherwise(4)
    one = lambda test: F.when(test, 1).otherwise(0)
    slot = lambda c: (c / PER_NUMBER).cast("int")
    shift = lambda c: (c % PER_NUMBER) * 5
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, slot(c)), shift(c)).bitwiseAND(F.lit(31).cast("long")).cast("double")
    unit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))

    def over(codes: Column) -> Column:
        # a character's code, the one that it pushes out, and whether each differs in class from its neighbour within
        def about(c: Column, i: Column) -> Column:
            went, old = F.when(i >= window, F.get(codes, i - window)), F.when(i >= window, F.get(codes, i - window + 1))
            before = F.when(i > 0, F.get(codes, i - 1))
            return F.struct(
                i.alias("i"),
                c.alias("c"),
                went.alias("went"),
                (one(upper(c)) - F.coalesce(one(upper(went)), F.lit(0))).alias("upper"),
                (one(lower(c)) - F.coalesce(one(lower(went)), F.lit(0))).alias("lower"),
                (one((i > 0) & (kind(c) != kind(before))) - one((i >= window) & (kind(went) != kind(old)))).alias("turns"),
            )

        def step(acc: Column, x: Column) -> Column:
            c, went = x["c"], x["went"]
            n = count(acc["counts"], c)
            added = F.transform(acc["counts"], lambda v, j: F.when(j == slot(c), v + unit(c)).otherwise(v))
            m = count(added, went)
            now = F.when(went.isNull(), added).otherwise(F.transform(added, lambda v, j: F.when(j == slot(went), v - unit(went)).otherwise(v)))
            total = acc["t"] + _term(n + 1) - _term(n) + F.when(went.isNull(), F.lit(0.0)).otherwise(_term(m - 1) - _term(m))
            k = F.least(x["i"] + 1, F.lit(window)).cast("double")
            full = (x["i"] + 1 >= window) | (x["i"] + 1 >= F.size(codes))
            bits = F.when(full, F.log2(k) - total / k).otherwise(F.lit(0.0))
            up, low, turns = acc["upper"] + x["upper"], acc["lower"] + x["lower"], acc["turns"] + x["turns"]
            mixed = (up >= MIXED) & (low >= MIXED) & (turns + 1 >= MIXED_RUNS * k)
            return F.struct(
                now.alias("counts"),
                total.alias("t"),
                up.alias("upper"),
                low.alias("lower"),
                turns.alias("turns"),
                F.greatest(acc["best"], bits).alias("best"),
                F.greatest(acc["mixed"], F.when(mixed, bits).otherwise(F.lit(0.0))).alias("mixed"),
            )

        zero = F.struct(F.array(*[F.lit(0).cast("long")] * NUMBERS).alias("counts"), F.lit(0.0).alias("t"), F.lit(0).alias("upper"), F.lit(0).alias("lower"), F.lit(0).alias("turns"), F.lit(0.0).alias("best"), F.lit(0.0).alias("mixed"))
        return F.aggregate(F.transform(codes, about), zero, step, lambda acc: F.struct(acc["best"].alias("best"), acc["mixed"].alias("mixed")))

    # the codes are made once, as the item of an array of one
    return F.transform(F.array(codes), over)[0]


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy of any window of s; see _windows."""
    return _windows(s, window)["best"]


def _suspicious(x: Column) -> Column:
    s, b = x["m"], x["b"]
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES):
        least = F.when(s.rlike(pattern), F.lit(bits).cast("double")).otherwise(least)
    placed = (F.length(s) <= ALLOWED_LENGTH) & s.rlike(PLACEHOLDER)
    return least.isNotNull() & ~placed & ~(b.rlike(ALLOWED_BEFORE) & s.rlike(DIGEST)) & F.exists(F.split(s, ALLOWED, -1), lambda p: _strong(p, least))


def _strong(p: Column, least: Column) -> Column:
    """Whether some window of p, a piece without hits of the allow-list, is that of a secret."""
    digits = p.rlike(LEAST[0]) & p.rlike(LEAST[1])
    found = F.transform(F.array(_windows(p)), lambda w: F.when(digits & (w["best"] >= least), True).otherwise(w["mixed"] >= F.greatest(least, F.lit(MIXED_BITS))))[0]
    return (F.length(p) >= WINDOW) & F.coalesce(found, F.lit(False))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def secret_spans(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with columns `base` and `spans`: arrays of struct<s, k, e> in order of start, then kind (an index in KINDS).

    base holds the pattern matches: leftmost and not overlapping within a kind, those that fail the
    kind's length dropped. spans adds the entropy candidates of the text outside of them and of the hosts and paths of URLs. Places are
    code points, ends exclusive. A null text is empty and has none; repeated rows have a row each, texts of any length are scanned whole.
    One pass over the rows without a shuffle; all other columns are kept, whatever their names, but for columns of those two names.
    """
    t = F.col("__t")
    none = F.expr(f"cast(array() as array<{MATCH}>)")
    # cheap tests first, so that most texts are gone through once and by no alternation
    some = lambda test, found: F.when(test, found).otherwise(none)
    low = F.lower(t)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    out = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("__row"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("__t"))
    out = out.withColumns(
        {
            "__a": some(named, F.filter(_matches(t, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN_VALUE, 1)) >= 6)),
            "__k": some(t.contains("AKIA"), _matches(t, ACCESS, 0)),
            "__h": some(t.rlike("(?<![0-9a-f])[0-9a-f]{24}"), _matches(t, HEX, 0)),
        }
    )
    out = out.withColumn("__b", F.array_sort(F.concat(_spans(F.col("__a"), 0), _spans(F.col("__k"), 1), _spans(F.col("__h"), 2))))
    # what is left of a candidate that base spans or URLs cut is a candidate of its own: a dot, which none holds, stands in their places
    dots = lambda n, fresh: F.repeat(F.lit("."), n)
    o = F.col("__o")
    out = out.withColumn("__u", F.array_sort(F.concat("__b", _spans(some(t.contains("://"), _matches(t, URL, 0)), len(KINDS)))))
    out = out.withColumn("__o", F.when(F.size("__u") > 0, _replaced(t, F.col("__u"), dots)).otherwise(t))
    out = out.withColumn("__c", some(o.rlike("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"), F.filter(_matches(o, CANDIDATE, 40), _suspicious)))
    rest = [F.col("__row").getField(c).alias(c) for c in docs.columns if c not in (base, spans)]
    return out.select(*rest, F.col("__b").alias(base), F.array_sort(F.concat("__b", _spans(F.col("__c"), 3))).alias(spans))


def _replaced(text: Column, spans: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """text with each of the spans, in order of start, replaced by mark(characters that it adds to those before it, whether it overlaps none).

    The text is cut into chunks first, as a place in a string is found by going there from its start.
    """
    place = F.struct(F.lit(0).alias("at"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(True).alias("fresh"))
    # the end of what is done, the span's start and end beyond it, and whether it starts there or later
    step = lambda a, x: F.struct(a["e"].alias("at"), F.greatest(x["s"], a["e"]).alias("s"), F.greatest(x["e"], a["e"]).alias("e"), (x["s"] >= a["e"]).alias("fresh"))
    places = _scan(spans, place, step, lambda _, a, x: a, "struct<at:int,s:int,e:int,fresh:boolean>")
    about = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"), places.alias("places"))

    def part(chunks: Column, a: Column, b: Column) -> Column:
        first = (a / CHUNK).cast("int")
        some = F.slice(chunks, first + 1, ((b - 1) / CHUNK).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(some, ""), a - first * CHUNK + 1, b - a)).otherwise(F.lit(""))

    def joined(r: Column) -> Column:
        parts = F.transform(r["places"], lambda p: F.concat(part(r["chunks"], p["at"], p["s"]), mark(p["e"] - p["s"], p["fresh"])))
        return F.concat(F.array_join(parts, ""), part(r["chunks"], F.element_at(r["places"], -1)["e"], F.length(text)))

    return F.when(F.size(spans) > 0, F.transform(F.array(about), joined)[0]).otherwise(text)


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by `mark`, overlapping ones by one; n_chars, if there, follows the text.

    Every row stays, repeated ones too, with all its columns, whatever their names; null and empty texts and those without spans do not change.
    """
    whole = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("__row"), F.col("text").alias("__old"))
    found = secret_spans(whole, "__old", "__base", "__spans")
    out = found.withColumn("__new", _replaced(F.col("__old"), F.col("__spans"), lambda n, fresh: F.when(fresh, F.lit(mark)).otherwise(F.lit(""))))
    changed = {"text": lambda old: F.col("__new"), "n_chars": lambda old: F.when(F.size("__spans") > 0, F.length("__new").cast(dict(docs.dtypes)["n_chars"])).otherwise(old)}
    return out.select(*(changed.get(c, lambda old: old)(F.col("__row").getField(c)).alias(c) for c in docs.columns))


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs; see secret_spans."""
    found = secret_spans(docs.select("doc_id", F.col("text").alias("__text")), "__text")
    number = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
