"""Secret scans: key patterns, and sliding-window entropy over candidate strings. DataFrame operations only.

Base kinds are patterns: `assign` (a secret's name, an equals sign or colon, a value of 6 characters or more), `access`
(AKIA keys) and `hex` (24 or more of 0-9a-f). The entropy kinds look at candidates, runs of 20 or more characters of
A-Za-z0-9+/_=-. A window of WINDOW characters slides over a candidate; counts of its characters and of its character
classes, and the sum of c * log2(c) over the characters, are updated by the one that enters and the one that leaves.
The classes in a window name its kind, and each kind has a bound of its own (BITS, from the windows of random strings
over its alphabet): `entropy_hex` (hexadecimal digits of one case, with a letter and a digit), `entropy_letters`
(letters of one case, with ODD_PAIRS or more neighbours that words hardly have), `entropy_alnum` (letters of one case and digits), `entropy_mixed` (letters of both cases, with
or without digits) and `entropy_base64` (with any of +/_=-). Windows whose Shannon entropy reaches the bound are joined
to spans by kind; windows of decimal digits only have none. The allow-list suppresses candidates that are wholly words
or identifiers (ALLOWED_WHOLE), and windows that overlap a well-known sample string (ALLOWED_PART). Base spans are
never suppressed.

Sums are kept as integers (millionths), so results do not depend on the order of additions. Spans are in code points,
end exclusive. Null texts are empty. Every row gives a row, repeated ones too; a null doc_id is kept. No rows: no rows.
Columns other than the text are carried as they are. Long texts and candidates are walked in blocks: work grows with
the text's length, for the places of n matches as n to the power of 1.5.
"""

from __future__ import annotations

from collections.abc import Callable
from math import floor, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbq.llm.common import free_name

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of letters and digits is one match, so this is AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_letters", "entropy_alnum", "entropy_mixed", "entropy_base64"]

WINDOW = 20
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
#: Least entropy of a window in bits, by kind. Nineteen in twenty windows of random hex, letters, alnum and mixed strings reach theirs.
BITS = {"entropy_hex": 2.75, "entropy_letters": 3.35, "entropy_alnum": 3.48, "entropy_mixed": 3.72, "entropy_base64": 3.9}
#: Candidates that are wholly one of these are no secrets: capitalised words, dashed identifiers, camel case, UUIDs. Words of one case are told by their pairs of letters.
ALLOWED_WHOLE = ["^[A-Z][a-z]++$", "^[a-z]++(?:[-_/+=][a-z]++)++$", "^[a-z]*+(?:[A-Z][a-z]++)++$", "^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"]
#: Windows that overlap one of these are no secrets.
ALLOWED_PART = ["(?i:example)", "0123456789", "(?i:abcdefghij)"]

#: The letters that often follow each letter in English, German, French and Spanish words.
FOLLOWERS = {
    "a": "bcdfgiklmnprstuvwyz", "b": "abeilorsuy", "c": "acehiklortu", "d": "adeiorsuy", "e": "abcdefghiklmnpqrstuvwxyz", "f": "aefilortu", "g": "aeghilnorstu", "h": "aeilmnortu", "i": "abcdefgklmnopqrstvz",
    "j": "aeou", "k": "aeilnostu", "l": "adefiklmostuvy", "m": "abeimopsu", "n": "acdefgiklnoqstuvyz", "o": "abcdfgiklmnoprstuvw", "p": "aehiloprstu", "q": "u", "r": "abcdefgiklmnoprstuvy",
    "s": "acehiklmnopqstuwy", "t": "aehilorstuwyz", "u": "abcdefgilmnprst", "v": "aeior", "w": "aehinors", "x": "aceiptu", "y": "aeilmnopst", "z": "aeiotuwz",
}
#: Least number of other pairs among the 19 of a window of letters. Random windows have 10 on average, one in a thousand of English words without blanks has 6.
ODD_PAIRS = 6
#: 1 for each pair of letters that words hardly have, by 26 * first + second.
_ODD = "".join(str(int(b not in FOLLOWERS[a])) for a in FOLLOWERS for b in FOLLOWERS)

_SCALE = 1_000_000
_TERMS = [0, *(round(c * log2(c) * _SCALE) for c in range(1, WINDOW + 1))]
#: Entropy is log2(W) - sum / W: a window reaches its bound if its sum is at most this.
LIMITS = {kind: floor((log2(WINDOW) - bits) * WINDOW * _SCALE) for kind, bits in BITS.items()}
#: Windows of one block, and characters of one block of a text.
_BLOCK = 256
_TEXT_BLOCK = 4096
_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """array<int>: for each entry, what `join` (a sum or a maximum, of values from 0 on) makes of the entries before it. By blocks of the root of their number."""

    def walk(entries: Column) -> Column:
        step = lambda done, x: F.struct(join(done["at"], x).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out"))
        return F.aggregate(entries, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)

    def of(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(v), size), lambda at: walk(F.slice(v, at, size)))
        return _let(blocks, lambda b: _let(walk(F.transform(b, lambda x: x["at"]))["out"], lambda heads: F.flatten(F.transform(b, lambda x, i: F.transform(x["out"], lambda y: join(y, F.get(heads, i)))))))

    return _let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _places(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """array<struct<start, stop, match>> of the matches; keep: array<boolean> that says which of them stay."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def of(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["match"]))
        place = lambda p, at: F.struct((at + F.length(p["gap"])).alias("start"), (at + F.length(p["gap"]) + F.length(p["match"])).alias("stop"), p["match"].alias("match"))
        return F.zip_with(pairs, _before(sizes, _sum), place)

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda p: p["match"].isNotNull())
    found = _let(pairs, of)
    if keep is not None:
        found = _let(F.arrays_zip(found.alias("place"), keep.alias("stays")), lambda z: F.transform(F.filter(z, lambda x: x["stays"]), lambda x: x["place"]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,stop:int,match:string>>"))


def _pieces(candidate: Column, pattern: str) -> Column:
    """array<struct<start, text>> of what lies between the pattern's matches."""
    whole = F.array(F.struct(F.lit(0).alias("start"), candidate.alias("text")))

    def between(places: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p["stop"]))
        return F.zip_with(starts, F.split(candidate, pattern, -1), lambda at, gap: F.struct(at.alias("start"), gap.alias("text")))

    return F.when(candidate.rlike(pattern), _let(_places(candidate, pattern), between)).otherwise(whole)


def _high_windows(text: Column) -> Column:
    """array<struct<start, kind, stop>>: windows of a block whose entropy reaches their kind's bound, neighbours of one kind joined, by incremental counts."""
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(text, i, F.lit(1))) - 1
    count = lambda counts, k: F.element_at(counts, k + 1)
    term = lambda c: F.element_at(F.array(*[F.lit(t).cast("long") for t in _TERMS]), c + 1)
    within = lambda k, first, stop: ((k >= first) & (k < stop)).cast("int")
    classes = {"digit": [(0, 10)], "upper": [(10, 36)], "lower": [(36, 62)], "other": [(62, len(ALPHABET))], "beyond": [(16, 36), (42, 62)]}  # beyond: letters that are no hexadecimal digits

    def odd(a: Column, b: Column) -> Column:
        """1 if b hardly follows a in words, of the codes of two letters; 0 where one is none."""
        letters = within(a, 10, 62) * within(b, 10, 62) == 1
        return F.when(letters, F.substring(F.lit(_ODD), (a - 10) % 26 * 26 + (b - 10) % 26 + 1, F.lit(1)).cast("int")).otherwise(F.lit(0))

    def step(state: Column, i: Column) -> Column:
        """i: the place, from 1, of the character that enters."""
        enters = code(i)
        leaves = F.when(i > WINDOW, code(i - WINDOW)).otherwise(F.lit(-1))
        after = F.when(i > WINDOW, code(i - WINDOW + 1)).otherwise(F.lit(-1))
        return _let(F.struct(enters.alias("enters"), leaves.alias("leaves"), after.alias("after")), lambda e: moved(state, i, e["enters"], e["leaves"], e["after"]))

    def moved(state: Column, i: Column, enters: Column, leaves: Column, after: Column) -> Column:
        """after: the character behind the one that leaves."""
        c_in = count(state["counts"], enters)
        c_out = F.greatest(count(state["counts"], F.greatest(leaves, F.lit(0))), F.lit(1))
        out = F.when(leaves >= 0, term(c_out - 1) - term(c_out)).otherwise(F.lit(0).cast("long"))
        same = enters == leaves
        total = F.when(same, state["total"]).otherwise(state["total"] + term(c_in + 1) - term(c_in) + out)
        counts = F.when(same, state["counts"]).otherwise(F.transform(state["counts"], lambda c, k: c + (k == enters).cast("int") - (k == leaves).cast("int")))
        seen = [(state[name] + sum(within(enters, a, b) - within(leaves, a, b) for a, b in ranges)).alias(name) for name, ranges in classes.items()]
        pairs = state["odd"] + odd(state["last"], enters) - odd(leaves, after)
        return _let(F.struct(counts.alias("counts"), total.alias("total"), *seen, enters.alias("last"), pairs.alias("odd")), lambda now: judged(state, i, now))

    def judged(state: Column, i: Column, now: Column) -> Column:
        number = {k: F.lit(KINDS.index(k)) for k in BITS}
        kind = (
            F.when(now["other"] > 0, number["entropy_base64"]).when((now["upper"] > 0) & (now["lower"] > 0), number["entropy_mixed"]).when(now["digit"] == 0, number["entropy_letters"])
            .when(now["upper"] + now["lower"] == 0, F.lit(0)).when(now["beyond"] == 0, number["entropy_hex"]).otherwise(number["entropy_alnum"])
        )
        limits = F.array(*[F.lit(LIMITS.get(k, -1)).cast("long") for k in KINDS])
        begin = i - WINDOW
        last = F.get(state["spans"], F.size(state["spans"]) - 1)
        joins = F.coalesce((last["stop"] >= begin) & (last["kind"] == kind), F.lit(False))
        fresh = F.struct(F.when(joins, last["start"]).otherwise(begin).alias("start"), kind.alias("kind"), i.alias("stop"))
        before = F.when(joins, F.slice(state["spans"], F.lit(1), F.size(state["spans"]) - 1)).otherwise(state["spans"])
        high = (i >= WINDOW) & (now["total"] <= F.element_at(limits, kind + 1)) & ((kind != number["entropy_letters"]) | (now["odd"] >= ODD_PAIRS))
        spans = F.when(high, F.concat(before, F.array(fresh))).otherwise(state["spans"])
        return F.struct(now["counts"].alias("counts"), now["total"].alias("total"), *[now[name].alias(name) for name in classes], now["last"].alias("last"), now["odd"].alias("odd"), spans.alias("spans"))

    first = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("total"), *[F.lit(0).alias(name) for name in classes], F.lit(-1).alias("last"), F.lit(0).alias("odd"), F.array().cast(_SPANS).alias("spans"))
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), first, step, lambda state: state["spans"])


def _in_blocks(piece: Column) -> Column:
    """The high windows of a piece of any length: of blocks that reach into the next one as far as a window does."""
    blocks = F.regexp_extract_all(piece["text"], F.lit(f".{{1,{_BLOCK}}}"), F.lit(0))

    def of(b: Column) -> Column:
        with_next = lambda text, i: F.concat(text, F.substring(F.coalesce(F.get(b, i + 1), F.lit("")), 1, WINDOW - 1))
        moved = lambda text, i: F.transform(_high_windows(with_next(text, i)), lambda s: _span(piece["start"] + i * _BLOCK + s["start"], s["kind"], piece["start"] + i * _BLOCK + s["stop"]))
        return F.flatten(F.transform(b, moved))

    return _let(blocks, of)


def _span(start: Column, kind: Column, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), stop.cast("int").alias("stop"))


def _joined(spans: Column) -> Column:
    """Spans of one kind, by start and with stops that do not fall, with those that touch made one."""

    def of(s: Column) -> Column:
        first = F.filter(s, lambda x, i: F.coalesce(x["start"] > F.get(s, i - 1)["stop"], F.lit(True)))
        last = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["start"] > x["stop"], F.lit(True)))
        return F.zip_with(first, last, lambda a, b: _span(a["start"], a["kind"], b["stop"]))

    return _let(spans, of)


def _of_kind(kind: str, places: Column) -> Column:
    return F.transform(places, lambda p: _span(p["start"], F.lit(KINDS.index(kind)), p["stop"]))


def _listed(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns) or "(?!)"


def entropy_spans(text: Column, whole: list[str] | None = None, part: list[str] | None = None) -> Column:
    """array<struct<start, kind, stop>> of the entropy kinds, by kind. whole, part: allow-lists in place of ALLOWED_WHOLE and ALLOWED_PART."""
    whole_list, part_list = _listed(ALLOWED_WHOLE if whole is None else whole), _listed(ALLOWED_PART if part is None else part)
    candidates = F.filter(_places(text, CANDIDATE), lambda c: ~(c["match"].rlike("^[0-9]+$") | c["match"].rlike(whole_list)))
    pieces = F.flatten(F.transform(candidates, lambda c: F.transform(_pieces(c["match"], part_list), lambda p: F.struct((c["start"] + p["start"]).alias("start"), p["text"].alias("text")))))
    high = F.flatten(F.transform(F.filter(pieces, lambda p: F.length(p["text"]) >= WINDOW), _in_blocks))
    of_kind = lambda h, kind: F.filter(h, lambda s: s["kind"] == KINDS.index(kind))
    return _let(high, lambda h: F.flatten(F.array(*[_joined(of_kind(h, kind)) for kind in BITS])))


def secret_spans(text: Column, whole: list[str] | None = None, part: list[str] | None = None) -> Column:
    """array<struct<start, kind, stop>> of all kinds, by start and kind; kind is a place in KINDS."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    spans = F.concat(
        _of_kind("assign", _places(text, ASSIGN, long_enough)),
        _of_kind("access", _places(text, ACCESS)),
        _of_kind("hex", _places(text, HEX)),
        entropy_spans(text, whole, part),
    )
    suspect = text.rlike(f"{ASSIGN}|{HEX}|{CANDIDATE}")  # every access key is a candidate
    return F.when(suspect, F.array_sort(spans)).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, to: str = "secret_spans", whole: list[str] | None = None, part: list[str] | None = None) -> DataFrame:
    """docs with the spans in column `to` (one of that name is replaced)."""
    return docs.withColumn(to, secret_spans(F.col("text"), whole, part))


def listing(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def _covered(spans: Column) -> Column:
    """array<struct<start, stop>>: the stretches that spans, by start, cover; those that touch are one."""

    def of(s: Column) -> Column:
        return _let(_before(F.transform(s, lambda x: x["stop"]), F.greatest), lambda reach: stretches(s, reach))

    def stretches(s: Column, reach: Column) -> Column:
        """reach: how far the spans before each one go."""
        opens = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] > F.get(reach, i)))
        end = F.array_max(F.transform(s, lambda x: x["stop"]))
        return F.struct(opens.alias("opens"), end.alias("end"))

    def pairs(s: Column, o: Column) -> Column:
        reach = _before(F.transform(s, lambda x: x["stop"]), F.greatest)
        return _let(reach, lambda r: F.transform(o["opens"], lambda i, j: F.struct(F.get(s, i)["start"].alias("start"), F.coalesce(F.get(r, F.get(o["opens"], j + 1)), o["end"]).alias("stop"))))

    return _let(spans, lambda s: _let(of(s), lambda o: pairs(s, o)))


def _without(text: Column, stretches: Column, mark: str) -> Column:
    """The text with each stretch replaced. It is read by blocks, so that many stretches of a long text do not each walk it from its start."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_TEXT_BLOCK}}}"), F.lit(0))

    def cut(b: Column, start: Column, stop: Column) -> Column:
        first, last = F.floor(start / _TEXT_BLOCK).cast("int"), F.floor((stop - 1) / _TEXT_BLOCK).cast("int")
        inner = lambda i, a, z: F.substring(F.coalesce(F.get(b, i), F.lit("")), a - i * _TEXT_BLOCK + 1, z - a)
        middle = F.array_join(F.slice(b, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        several = F.concat(inner(first, start, (first + 1) * _TEXT_BLOCK), middle, inner(last, last * _TEXT_BLOCK, stop))
        return F.when(stop <= start, F.lit("")).when(first == last, inner(first, start, stop)).otherwise(several)

    def parts(b: Column, c: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(c, lambda x: x["stop"]))
        ends = F.concat(F.transform(c, lambda x: x["start"]), F.array(F.length(text)))
        return F.array_join(F.zip_with(begins, ends, lambda a, z: cut(b, a, z)), mark)

    return _let(blocks, lambda b: _let(stretches, lambda c: parts(b, c)))


def redact(docs: DataFrame, mark: str = "[secret]", whole: list[str] | None = None, part: list[str] | None = None) -> DataFrame:
    """docs with every stretch of `text` that a span covers replaced by `mark`; other columns as they are. Null texts stay null."""
    # step by step, in columns of their own: one nested expression would be too deep for the analyzer
    spans, text = free_name(docs, "spans"), F.col("text").cast("string")
    found = scan(docs, spans, whole, part).withColumn(spans, F.when(F.size(spans) > 0, _covered(F.col(spans))))
    return found.withColumn("text", F.when(F.col(spans).isNotNull(), _without(text, F.col(spans), mark)).otherwise(text)).drop(spans)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select("doc_id", "secret_spans")
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("secret_spans")).alias("spans"))


def _sql() -> str:
    word = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join([word("password"), word("passwd"), word("secret"), word("token"), word("api") + "_?" + word("key")])
    assign = rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    terms = "[" + ", ".join(map(str, _TERMS)) + "]"
    greedy = lambda patterns: "|".join(f"({p})" for p in patterns).replace("++", "+").replace("*+", "*")  # noqa: E731  the same matches
    at = lambda q: f"(ascii(substring(lower(s), ({q})::BIGINT, 1)) - 97)"
    pairs = f"list_sum(list_transform(range(1, {WINDOW}), lambda q: substring('{_ODD}', ({at('q')} * 26 + {at('q + 1')} + 1)::BIGINT, 1)::INT))"
    place = lambda kind, pattern, more="": rf"""
  SELECT doc_id, {kind} AS kind, start, start + length(m[i]) AS stop, m[i] AS match FROM (
    SELECT doc_id, m, i, list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0) AS start {', v' if more else ''}
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g {f", regexp_extract_all(text, '{pattern}', 2) AS v" if more else ''} FROM d), unnest(range(1, len(m) + 1)) AS t(i)) {more}"""  # noqa: E731
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({place(0, assign, "WHERE length(v[i]) >= 6")} UNION ALL {place(1, ACCESS)} UNION ALL {place(2, HEX)}),
c AS (SELECT doc_id, start, match, regexp_extract_all(match, '{greedy(ALLOWED_PART)}') AS m, string_split_regex(match, '{greedy(ALLOWED_PART)}') AS g FROM ({place(9, CANDIDATE)}) WHERE NOT regexp_matches(match, '^[0-9]+$') AND NOT regexp_matches(match, '{greedy(ALLOWED_WHOLE)}')),
pieces AS (SELECT doc_id, g[i] AS piece, start + coalesce(list_sum(list_transform(g[1:i-1], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0) AS start FROM c, unnest(range(1, len(g) + 1)) AS t(i)),
w AS (SELECT doc_id, start, start + j AS a, substring(piece, (j + 1)::BIGINT, {WINDOW}) AS s FROM pieces, unnest(range(0, length(piece) - {WINDOW - 1})) AS t(j)),
e AS (SELECT doc_id, start, a, CASE WHEN regexp_matches(s, '[+/_=-]') THEN {KINDS.index("entropy_base64")} WHEN regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[a-z]') THEN {KINDS.index("entropy_mixed")} WHEN NOT regexp_matches(s, '[0-9]') THEN {KINDS.index("entropy_letters")}
  WHEN NOT regexp_matches(s, '[A-Za-z]') THEN 0 WHEN NOT regexp_matches(s, '[G-Zg-z]') THEN {KINDS.index("entropy_hex")} ELSE {KINDS.index("entropy_alnum")} END AS k2,
  list_sum(list_transform(list_distinct(string_split(s, '')), lambda x: ({terms})[length(s) - length(replace(s, x, '')) + 1])) AS total, s FROM w),
h AS (SELECT doc_id, k2, start, a FROM e WHERE total <= ({[LIMITS.get(k, -1) for k in KINDS]})[k2 + 1] AND (k2 <> {KINDS.index("entropy_letters")} OR {pairs} >= {ODD_PAIRS})),
o AS (SELECT *, coalesce(a > lag(a) OVER (PARTITION BY doc_id, k2, start ORDER BY a) + {WINDOW}, TRUE)::INT AS fresh FROM h),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, k2, start ORDER BY a) AS run FROM o),
spans AS (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT doc_id, k2, min(a), max(a) + {WINDOW} FROM r GROUP BY doc_id, k2, start, run),
lists AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(x, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY start, kind, stop) AS every
  FROM (SELECT *, ({KINDS})[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS x FROM spans) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN lists USING (doc_id)
"""


ORACLE_SQL = {"op4_secret_scan": _sql()}
