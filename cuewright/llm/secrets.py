"""Secret scans: base patterns, and a battery of randomness tests, all in DataFrame functions.

Base kinds: ``assign`` (a keyword, a sign and a value of 12 or more characters), ``access``
(an access key id) and ``hex`` (16 or more lower-case hexadecimal digits).

Battery (kind ``random``): each maximal run of ``MIN_LENGTH`` or more characters of
``[A-Za-z0-9+/_-]`` whose make-up suggests an encoding (hex, base 32, upper or lower base 36,
base 64; a run of letters that could be a word suggests none) is tested against a uniform
source over that encoding's alphabet:

* chi-squared uniformity of the alphabet,
* Wald-Wolfowitz runs of the upper and lower half of the alphabet,
* serial correlation of neighbouring codes.

The three z scores, the first one-sided, are combined as a sum of squares into one p value,
which is uniform for random strings and near zero for others. False discoveries are then
controlled per encoding and length class: the share of random strings among those with
p >= t is estimated from the upper half of the p values (all runs of the corpus in that
class), and t is the smallest of a fixed grid at which the estimated share of others is at
most ``FDR``. One pseudo-observation keeps classes of a few runs defined. A run that
overlaps a base span adds nothing. What reaches the driver is at most one row for each
encoding, length class and step of the grid.

Defined results: a null text counts as empty and has no spans; repeated rows get equal
results; an empty table gives an empty table. Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import Workspace, free_name, read

MIN_LENGTH = 16
FDR = 0.05
STEPS = 200  # grid of p values

# the contract's patterns and kinds, in its order (fixed values)
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

RUN = rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "lower36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>.

    The gaps between matches come from split(), the matches from regexp_extract_all();
    positions are running sums of both. ``value`` is the given group of the match.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"),
        whole.alias("all"),
        (whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("value"),
    )
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, value: string>>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["all"])
        own = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, zero, add, lambda acc: acc["out"])).otherwise(none)


def encoding(run: Column) -> Column:
    """The encoding that a run suggests; null where it could be a word or a number."""
    digit, upper, lower = run.rlike("[0-9]"), run.rlike("[A-Z]"), run.rlike("[a-z]")
    return (
        F.when(run.rlike("^[0-9]+$"), F.lit(None))
        .when(digit & (run.rlike("^[0-9a-f]+$") | run.rlike("^[0-9A-F]+$")), "hex")
        .when(digit & run.rlike("^[A-Z2-7]+$"), "base32")
        .when(digit & run.rlike("^[A-Z0-9]+$"), "upper36")
        .when(digit & run.rlike("^[a-z0-9]+$"), "lower36")
        .when((digit & upper & lower) | run.rlike("[a-z][A-Z]"), "base64")
    )


def _cdf(z: Column) -> Column:
    """Standard normal distribution function, logistic form (absolute error under 2e-4)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(1.5976) * z + F.lit(0.070565992) * z * z * z)))


def tested(found: Column) -> Column:
    """Runs that suggest an encoding, with its name, their length class and their p value.

    Each step binds what the next one uses several times to a field, so nothing is written
    out, or computed, more than once.
    """
    named = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("run"), encoding(x["value"]).alias("encoding")))
    named = F.filter(named, lambda r: r["encoding"].isNotNull())
    alphabets = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    keep = lambda r, *names: [r[n].alias(n) for n in names]

    def prepare(r: Column) -> Column:
        clean = F.when(r["encoding"] == "hex", F.lower(r["run"])).when(r["encoding"] == "base64", F.translate(r["run"], "-_", "+/")).otherwise(r["run"])
        return F.struct(*keep(r, "start", "end", "encoding"), length_class(r["run"]).alias("size"), clean.alias("clean"), F.element_at(alphabets, r["encoding"]).alias("letters"))

    def code(r: Column) -> Column:
        codes = F.transform(F.split(r["clean"], ""), lambda ch: (F.instr(r["letters"], ch) - 1).cast("double"))
        squares = F.aggregate(
            F.split(r["letters"], ""),
            F.lit(0.0),
            lambda acc, ch: acc + F.pow(F.length(r["clean"]) - F.length(F.replace(r["clean"], ch, F.lit(""))).cast("double"), F.lit(2.0)),
        )
        n, k = F.length(r["clean"]).cast("double"), F.length(r["letters"]).cast("double")
        return F.struct(*keep(r, "start", "end", "encoding", "size"), n.alias("n"), k.alias("k"), squares.alias("squares"), codes.alias("codes"))

    def moments(r: Column) -> Column:
        x = r["codes"]
        pairs = F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x) - 1).alias("b"))
        high = F.size(F.filter(x, lambda v: v >= r["k"] / 2)).cast("double")
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / r["n"]
        return F.struct(*keep(r, "start", "end", "encoding", "size", "n", "k", "squares", "codes"), pairs.alias("pairs"), high.alias("high"), (r["n"] - high).alias("low"), mean.alias("mean"))

    def scores(r: Column) -> Column:
        n, k, mean = r["n"], r["k"], r["mean"]
        chi = (r["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        turns = F.size(F.filter(r["pairs"], lambda p: (p["a"] >= k / 2) != (p["b"] >= k / 2))) + 1
        mixed = 2 * r["high"] * r["low"]
        spread = F.sqrt(F.greatest(mixed * (mixed - n) / (n * n * (n - 1)), F.lit(1e-9)))
        # all in one half: as unlikely as a run of n equal coin tosses
        runs = F.when(mixed == 0, F.sqrt(n)).otherwise((turns - 1 - mixed / n) / spread)
        around = F.aggregate(r["codes"], F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
        along = F.aggregate(r["pairs"], F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean))
        serial = F.when(around > 0, (along / around + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
        total = F.pow(F.greatest(chi, F.lit(0.0)), F.lit(2.0)) + runs * runs + serial * serial
        # chi-squared with three degrees of freedom by Wilson and Hilferty
        z = (F.pow(total / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / F.sqrt(F.lit(2 / 27))
        return F.struct(*keep(r, "start", "end", "encoding", "size"), z.alias("z"))

    def final(r: Column) -> Column:
        return F.struct(*keep(r, "start", "end", "encoding", "size"), (F.lit(1.0) - _cdf(r["z"])).alias("p"))

    out = named
    for step in (prepare, code, moments, scores, final):
        out = F.transform(out, step)
    return out


def length_class(run: Column) -> Column:
    """Half powers of two, 64 at most."""
    return F.least(F.floor(F.log2(F.length(run).cast("double")) * 2), F.lit(64)).cast("int")


def scan(docs: DataFrame, name: str = "secrets", text: str = "text") -> DataFrame:
    """``docs`` with a struct of base spans and tested runs (no decision yet)."""
    raw, runs = free_name(docs, "raw__"), free_name(docs, "runs__")
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn(
        raw,
        F.struct(
            F.filter(located(t, ASSIGN, 2), lambda x: F.length(x["value"]) >= 12).alias("assign"),
            located(t, ACCESS).alias("access"),
            located(t, HEX).alias("hex"),
            located(t, RUN).alias("runs"),
        ),
    )

    def tagged(kind: int) -> Column:
        return F.transform(
            F.col(raw)[KINDS[kind]],
            lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")),
        )

    found = found.withColumn(runs, tested(F.col(raw)["runs"]))
    return found.withColumn(
        name,
        F.struct(
            F.array_sort(F.concat(*[tagged(k) for k in range(3)])).alias("base"),
            F.col(runs).alias("runs"),
        ),
    ).drop(raw, runs)


def thresholds(scanned: DataFrame, name: str = "secrets", fdr: float = FDR) -> list[tuple[str, int, float]]:
    """(encoding, length class, smallest p accepted as random), classes without any left out."""
    cells = (
        scanned.select(F.explode(f"{name}.runs").alias("r"))
        .groupBy(F.col("r.encoding").alias("encoding"), F.col("r.size").alias("size"),
                 F.least(F.floor(F.col("r.p") * STEPS), F.lit(STEPS - 1)).cast("int").alias("step"))
        .count()
        .collect()
    )
    hist: dict[tuple[str, int], list[float]] = {}
    for c in cells:
        hist.setdefault((c["encoding"], c["size"]), [1 / STEPS] * STEPS)[c["step"]] += c["count"]
    out = []
    for (kind, size), h in sorted(hist.items()):
        random = 2 * sum(h[STEPS // 2 :])
        above = sum(h)
        for step in range(STEPS):
            if step and 1 - random * (1 - step / STEPS) / max(above, 1e-9) <= fdr:
                out.append((kind, size, step / STEPS))
                break
            above -= h[step]
    return out


def decide(scanned: DataFrame, accepted: list[tuple[str, int, float]], name: str = "secrets") -> Column:
    """All spans of a row, sorted: base ones and accepted runs clear of them."""
    s = F.col(name)
    none = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")
    ok = none
    if accepted:
        floor = F.create_map(*[F.lit(x) for kind, size, t in accepted for x in (f"{kind}/{size}", t)])
        fine = F.filter(
            s["runs"],
            lambda r: (r["p"] >= F.try_element_at(floor, F.concat_ws("/", r["encoding"], r["size"])))
            & ~F.exists(s["base"], lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])),
        )
        ok = F.transform(fine, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return F.array_sort(F.concat(s["base"], ok))


def as_text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document row: doc_id, base and spans as arrays of (start, kind, end)."""
    work = Workspace(docs.sparkSession, "secrets")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scanned = work.put(scan(named).select("doc_id", "secrets"), "scanned")
    accepted = thresholds(scanned, fdr=fdr)
    return scanned.select("doc_id", F.col("secrets.base").alias("base"), decide(scanned, accepted).alias("spans"))


def redact(docs: DataFrame, *, text: str = "text", fdr: float = FDR) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``<secret>``; overlapping spans become one.

    The scanned rows are written once: the corpus statistics and the replacement both read them.
    """
    name = free_name(docs, "secrets")
    scanned = Workspace(docs.sparkSession, "redact").put(scan(docs, name, text), "scanned")
    spans = decide(scanned, thresholds(scanned, name, fdr), name)
    t = F.col(text)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, x: Column) -> Column:
        gap = F.substring(t, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.when(
            x["start"] >= acc["at"],
            F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, F.lit("<secret>")).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(spans, zero, cut, lambda acc: F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))))
    return scanned.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(t)).drop(name)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``find_secrets`` over whole documents."""
    found = find_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
