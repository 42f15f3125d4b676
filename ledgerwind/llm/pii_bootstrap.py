"""Personal data: exact patterns as seeds, and bootstrapped contextual extraction for what they miss.

Everything runs as DataFrame expressions. Base spans (email, ip, card, phone) come from regular expressions and their
checks. Then, over the whole corpus:

* candidates are whole runs: tokens with an at sign, groups of digits, and tokens of mixed letters and digits;
* candidates that overlap a base span are seed instances of its kind; long hexadecimal tokens are seeds of a fifth kind,
  `secret`, which is told apart from personal data in the results; candidates that can be of no kind, such as 16 digits that
  fail the checksum, are negative seeds;
* each candidate bears lexical patterns: the two words before it (L), the words on both sides (S), the word before it with
  the instance's form, its digits and marks with letters left out (B), and a field's name with its separator (K);
* pattern and instance scores are computed in turn, ROUNDS times, on the graph of (pattern, instance, count). With w the
  scores of a pattern's occurrences for a kind, its confidence is w / (occurrences of known instances of any kind, negative
  ones included, + 1): an instance of unknown kind is what is looked for and no fault, but w must be LEAST_SHARE of all
  occurrences, so that a common phrase which a few seeds happen to follow says nothing. SUPPORT different instances of the
  kind must bear a pattern. An instance that is no seed scores the confidence of its best pattern among the kinds that its
  form allows;
* candidates that no base span covers become spans under patterns of CONFIDENCE and more. A form alone, without words, is no
  context: one in ten numbers passes a card's checksum by chance, and in a table of plain numbers nothing tells them apart.

The graph's edges are counted before they are shuffled, so a hot pattern or identifier is one row for each different
partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwind.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns for Java: nothing follows their repetitions, so these may be possessive, and a match can
#: begin inside a run only where the last one ended, so that no run is read twice.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a search to be worth while.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Runs that may be identifiers: at-sign tokens, tokens of letters and digits, digits in groups, other digits. Runs begin where
#: no run can have begun before, and repetitions are possessive, so that long runs are read once.
CANDIDATE = "|".join([
    r"(?<![^\s@()\[\]<>,;:\x22'])[^\s@()\[\]<>,;:\x22']++(?:@|\(at\)|\[at\])[^\s@()\[\]<>,;:\x22']*[^\s@()\[\]<>,;:\x22'.!?]",
    r"(?<![A-Za-z0-9_-])(?=[0-9_-]*+[A-Za-z])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+",
    r"(?<![0-9A-Za-z])\+?\(?[0-9]{1,4}(?![0-9])\)?(?:[\x20.-]{1,2}\(?[0-9]{2,4}(?![0-9])\)?){2,}+",
    r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[().\[\]-]{0,3}[0-9])++",
])
AT, SECRET = r"@|\(at\)|\[at\]", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,128}$"
LEARNT = (*KINDS, "secret")
#: The kind of negative seeds; it comes after all others, so that an instance which is a seed elsewhere stays one.
NO_KIND = "~"
#: An address in four parts, however they are parted.
FOUR = r"^[0-9]{1,3}(?:(?:[.-]|\[\.\]|\(\.\))[0-9]{1,3}){3}$"
#: Least digits of a candidate without letters.
DIGITS = 7
#: Characters around a candidate in which its context is looked for; the candidates next to it are one character there.
CONTEXT = 64
ROUNDS, SUPPORT, CONFIDENCE, USEFUL = 3, 5, 0.8, 0.5
#: The least share of a pattern's occurrences that known instances of its kind must have.
LEAST_SHARE = 0.2
#: Documents with found spans up to which masking broadcasts them (some 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_FOUND = 50_000
#: Hits whose places are summed up at a time.
HITS = 512

SPAN = "struct<kind:string,start:bigint,end:bigint>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _located(text: Column, pattern: str, hint: Column) -> Column:
    """Array of (hit, start, gap, rest): all matches, their places in code points, and the text before and behind them.

    The text between matches gives their places: sums of lengths, taken in blocks of HITS.
    """

    def placed(gaps: Column, hits: Column) -> Column:
        rows = F.transform(hits, lambda h, i: F.struct(h.alias("hit"), F.get(gaps, i).alias("gap"), F.get(gaps, i + 1).alias("rest"), (F.length(h) + F.length(F.get(gaps, i))).cast("long").alias("n")))
        blocks = _let(rows, lambda rows: F.transform(F.sequence(F.lit(1), F.size(hits), F.lit(HITS)), lambda b: F.slice(rows, b, HITS)))

        def sums(amounts: Column) -> Column:
            """Running sums, that of none first."""
            return F.aggregate(amounts, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

        def in_block(block: Column, base: Column) -> Column:
            before = sums(F.transform(block, lambda r: r["n"]))
            return _let(before, lambda before: F.transform(block, lambda r, i: F.struct(r["hit"].alias("hit"), (base + F.get(before, i) + F.length(r["gap"])).alias("start"), r["gap"].alias("gap"), r["rest"].alias("rest"))))

        totals = lambda blocks: sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, r: a + r["n"])))
        return _let(blocks, lambda blocks: _let(totals(blocks), lambda base: F.flatten(F.transform(blocks, lambda b, i: in_block(b, F.get(base, i))))))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = _let(hits, lambda hits: F.when(F.size(hits) > 0, _let(F.split(text, pattern, -1), lambda gaps: placed(gaps, hits))))
    return F.coalesce(F.when(hint, found), F.array().cast("array<struct<hit:string,start:bigint,gap:string,rest:string>>"))


def _luhn(digits: Column) -> Column:
    """Whether the digits' sum, every second one from the right doubled (less 9 over 9), is divisible by 10."""
    worth = lambda c, i: _let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), worth), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return _let(F.regexp_replace(hit, r"[\x20-]", ""), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of the base spans, by kind and start; text must not be null."""

    def of(kind: str) -> Column:
        kept = F.filter(_located(text, BASE[kind], text.rlike(HINT[kind])), lambda r: _valid(kind, r["hit"]))
        return F.transform(kept, lambda r: F.struct(F.lit(kind).alias("kind"), r["start"].alias("start"), (r["start"] + F.length(r["hit"])).alias("end")))

    return F.concat(*map(of, KINDS)).cast(f"array<{SPAN}>")


def _form(hit: Column) -> Column:
    """An instance's digits and marks without its letters; for tokens of letters and digits, hexadecimal or not, and the length."""
    token = F.concat(F.when(hit.rlike("^[0-9A-Fa-f]+$"), "H").otherwise("T"), F.length(hit).cast("string"))
    at, digits = F.regexp_replace(hit, r"[\p{L}\p{N}._%+-]+", "x"), F.left(F.translate(hit, "0123456789", "D" * 10), F.lit(CONTEXT))
    return F.when(hit.rlike(AT), F.left(at, F.lit(CONTEXT))).when(hit.rlike("[A-Za-z]"), token).otherwise(digits)


def _fits(hit: Column) -> Column:
    """Array of the kinds that an instance's form, and a card's checksum, allow."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    parts = F.split(F.regexp_replace(hit, "[^0-9]+", " "), " ")
    numbers = {"ip": F.when(hit.rlike(FOUR), F.forall(parts, lambda x: x.cast("int") <= 255)), "card": F.when(F.length(digits).between(13, 19), _luhn(digits)), "phone": F.length(digits).between(7, 15)}
    of = F.filter(F.array(*(F.when(ok, kind) for kind, ok in numbers.items())), lambda k: k.isNotNull())
    return F.when(hit.rlike(AT), F.array(F.lit("email"))).when(hit.rlike("[A-Za-z]"), F.array(F.lit("secret"))).otherwise(of)


def candidates(text: Column, base: Column) -> Column:
    """Array of candidates: instance, start, end, the kinds that overlap it (seeds), those its form allows, and its patterns."""
    none = F.lit("")

    def one(r: Column, before: Column, behind: Column, base: Column) -> Column:
        end = r["start"] + F.length(r["hit"])
        found = F.array_distinct(F.transform(F.filter(base, lambda s: (s["start"] < end) & (s["end"] > r["start"])), lambda s: s["kind"]))

        def seeds(fits: Column) -> Column:
            return F.when(F.size(found) > 0, found).when(r["hit"].rlike(SECRET), F.array(F.lit("secret"))).when(F.size(fits) == 0, F.array(F.lit(NO_KIND))).otherwise(F.array().cast("array<string>"))

        def patterns(b: Column, a: Column, form: Column) -> Column:
            last = F.try_element_at(b, F.lit(-1))
            return F.array(
                F.when(F.size(b) > 1, F.concat(F.lit("L "), F.lower(F.array_join(F.slice(b, F.size(b) - 1, 2), " ")))),
                F.when((F.size(b) > 0) & (a != ""), F.concat(F.lit("S "), F.lower(last), F.lit(" _ "), F.lower(a))),
                F.when(F.size(b) > 0, F.concat(F.lit("B "), F.lower(last), F.lit(" "), form)),
                F.when(last.rlike("[:=]$"), F.concat(F.lit("K "), F.lower(last))),
            )

        words = F.filter(F.split(before, r"\s+"), lambda w: w != "")
        next_ = F.regexp_extract(behind, r"^[^\s]*\s+([^\s]+)", 1)
        made = _let(F.struct(words.alias("b"), next_.alias("a"), _form(r["hit"]).alias("f")), lambda x: patterns(x["b"], x["a"], x["f"]))
        instance = F.when(F.length(r["hit"]) <= CONTEXT, r["hit"]).otherwise(F.md5(r["hit"].cast("binary")))
        kept = F.filter(made, lambda p: p.isNotNull())
        return _let(_fits(r["hit"]), lambda fits: F.struct(instance.alias("instance"), r["start"].alias("start"), end.alias("end"), seeds(fits).alias("seeds"), fits.alias("fits"), kept.alias("patterns")))

    def every(rows: Column, base: Column) -> Column:
        def at(r: Column, i: Column) -> Column:
            ahead = F.when(i > 0, F.concat(F.right(F.get(rows, i - 1)["gap"], F.lit(CONTEXT)), F.lit("#"))).otherwise(none)
            then = F.when(i + 1 < F.size(rows), F.concat(F.lit("#"), F.left(F.get(rows, i + 1)["rest"], F.lit(CONTEXT)))).otherwise(none)
            before = F.right(F.concat(ahead, F.right(r["gap"], F.lit(CONTEXT))), F.lit(CONTEXT))
            behind = F.left(F.concat(F.left(r["rest"], F.lit(CONTEXT)), then), F.lit(CONTEXT))
            enough = r["hit"].rlike(f"[A-Za-z]|{AT}|{FOUR}") | (F.length(F.regexp_replace(r["hit"], "[^0-9]", "")) >= DIGITS)
            return F.when(enough, F.struct(r["hit"].alias("hit"), r["start"].alias("start"), before.alias("before"), behind.alias("behind")))

        return F.transform(F.filter(F.transform(rows, at), lambda r: r.isNotNull()), lambda r: one(r, r["before"], r["behind"], base))

    some = text.rlike("[0-9]") | text.contains("@") | text.contains("(at)") | text.contains("[at]")
    return _let(base, lambda base: _let(_located(text, CANDIDATE, some), lambda rows: every(rows, base)))


def patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of confident patterns, a row for each kind, from rows of (c: candidates array)."""
    rows = found.select(F.explode("c").alias("c")).select("c.instance", "c.seeds", "c.fits", F.explode("c.patterns").alias("pattern"))
    edges = written(rows.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.min(F.get("seeds", F.lit(0))).alias("seed"), F.first("fits").alias("fits")), "pii-edges")
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    seeds = edges.filter("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind")).withColumn("score", F.lit(1.0))
    scores, confident = seeds, None
    for _ in range(ROUNDS):
        borne = edges.select("pattern", "instance", "n").join(scores, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("w"), F.count_if(F.col("score") >= USEFUL).alias("support"))
        known = borne.groupBy("pattern").agg(F.sum("w").alias("known"))
        enough = (F.col("kind") != NO_KIND) & (F.col("support") >= SUPPORT) & (F.col("w") >= LEAST_SHARE * F.col("total"))
        confident = borne.join(known, "pattern").join(totals, "pattern").filter(enough).withColumn("confidence", F.col("w") / (F.col("known") + 1)).filter(F.col("confidence") >= USEFUL)
        confident = written(confident.select("pattern", "kind", "confidence"), "pii-patterns")
        new = edges.filter("seed is null").select("pattern", "instance", "fits").join(confident, "pattern").filter("array_contains(fits, kind)")
        new = new.groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
        scores = seeds.unionByName(new.join(seeds.select("instance"), "instance", "left_anti"))
    return confident.filter(F.col("confidence") >= CONFIDENCE)


def _found(rows: DataFrame, confident: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, found: array of spans) of rows (keys, c): what confident patterns add, at most one kind a candidate, and secrets."""
    every = rows.select(*keys, F.explode("c").alias("c"))
    open_ = every.filter(F.size("c.seeds") == 0).select(*keys, "c.start", "c.end", "c.fits", F.explode("c.patterns").alias("pattern"))
    spans = open_.join(confident, "pattern").filter("array_contains(fits, kind)")
    best = spans.groupBy(*keys, "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    own = every.filter(F.get("c.seeds", F.lit(0)) == "secret").select(*keys, "c.start", "c.end", F.lit("secret").alias("kind"))
    return best.unionByName(own).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _by_kind(spans: Column) -> Column:
    """Spans by kind, in the order of KINDS, then start."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(LEARNT) for x in (k, i)))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, secrets) for each row of docs (doc_id, text).

    The counts and base_sha256 are of the base spans; spans has these and all that were added; secrets has the spans of
    kind `secret`, which is no personal data. Null counts as empty: no spans, empty strings.
    Repeated rows and null doc_ids each return a row; other columns are ignored; an empty table gives none.
    """
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    seen = text.withColumn("base", base_spans(F.col("text"))).withColumn("c", candidates(F.col("text"), F.col("base")))
    rows = written(seen.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "c"), "pii-spans")
    some = rows.filter(F.size("c") > 0)
    added = _found(some, patterns(some), ["row"])
    whole = rows.select("row", "doc_id", "base").join(added, "row", "left").withColumn("found", F.coalesce("found", F.array().cast(f"array<{SPAN}>")))
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    of = lambda personal: F.filter("found", lambda s: (s["kind"] != "secret") if personal else (s["kind"] == "secret"))
    return whole.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(_by_kind(F.concat("base", of(True)))).alias("spans"), _joined(of(False)).alias("secrets"))


def _masked(text: Column, spans: Column) -> Column:
    """text with each span, or run of overlapping ones, as [KIND] of its first."""

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    ordered = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    merged = F.aggregate(ordered, F.array().cast(f"array<{SPAN}>"), merge)

    def pieces(m: Column) -> Column:
        after = lambda i: F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(F.lit(0).cast("long"))
        parts = F.transform(m, lambda s, i: F.concat(text.substr((after(i) + 1).cast("int"), (s["start"] - after(i)).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), text.substr((F.element_at(m, -1)["end"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(merged, pieces))


def mask(docs: DataFrame) -> DataFrame:
    """docs with all spans in text masked as [EMAIL], [IP], [CARD], [PHONE] or [SECRET]; a null text stays null.

    n_chars, where there is such a column, is counted again. Patterns are learnt from all rows first; the few documents in
    which they find spans meet their rows by doc_id and the text's hash.
    """
    text = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text").filter("text is not null")
    seen = text.withColumn("c", candidates(F.col("text"), base_spans(F.col("text"))))
    some = written(seen.select("id", "hash", "c").filter(F.size("c") > 0), "pii-candidates")
    found = written(_found(some, patterns(some), ["id", "hash"]).select("id", "hash", F.array_distinct("found").alias("found")), "pii-found")
    if found.count() <= BROADCAST_FOUND:
        found = F.broadcast(found)
    rows = docs.select(F.struct("*").alias("doc"))  # so that no column of docs can clash
    whole = rows.join(found, F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("doc.text") == F.col("hash")), "left")
    spans = F.concat(base_spans(F.col("doc.text")), F.coalesce("found", F.array().cast(f"array<{SPAN}>")))
    whole = whole.select("doc", F.when(F.col("doc.text").isNotNull(), _let(spans, lambda s: _masked(F.col("doc.text"), s))).alias("masked"))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("masked").cast(docs.schema["n_chars"].dataType)
    return whole.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
