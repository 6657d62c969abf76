"""Personal data by pattern, and terms that give it away, in DataFrame functions alone.

Base spans: e-mail, ip, card and phone patterns, leftmost and non-overlapping for each kind;
matches that fail their check (parts of an address over 255, Luhn, digit counts) are dropped.

Terms: a protected entity is a distinct base match, and so is what a match belongs to (its kind, a mail domain, the head of
a number).  Over the whole texts of the corpus, a term t discloses an entity e by the share of e's information that t
carries, PMI(t, e) / IC(e) = 1 - log p(e | t) / log p(e).  p(e) is the share of documents that hold e, and p(e | t) that of
the documents with t that also hold e, as if there were ``prior`` more documents with t that don't; so a rare word of the
only text with an entity counts, but less than one that many of its texts share.  Terms are all words of letters and
digits outside of what looks like a base match.  A term at or over ``generalise`` for any entity becomes a placeholder
in every text of the corpus, one at or over ``remove`` goes.  What all documents hold carries no information and
has no terms.

Entities, pairs and term counts come from all documents; each is counted before it is joined.  Entities that stand in the
same texts have the same terms and are one group, so a page of thousands of addresses is paired with its words once.
What is broadcast is counted before, in rows and bytes (BROADCAST_ROWS, BROADCAST_BYTES), and joins by a shuffle beyond
that, common words filtered out by a bitmap of fixed size.  Null texts are empty.
Terms belong to a text, not to an id: rows with equal or null ``doc_id`` are rows of their own, and
equal texts get equal spans.  An empty table gives none.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayloom.llm.common import documents, drop_written, written

#: The base kinds in order, with possessive forms of the patterns where that changes no match.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs to be worth a search for the kind.
NEEDS = {"email": F.contains, "ip": F.rlike, "card": F.rlike, "phone": F.contains}
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": "+"}
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"  # of a part that has a digit; all may be zeros
NO_WORD = r"[^\p{L}\p{N}]+"
SPAN = "array<struct<start: int, end: int, kind: string, text: string>>"
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Bits of the filter of terms.
BITMAP = 1 << 22


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(lengths: Column, block: int = 64, levels: int = 3) -> Column:
    """Sums of an integer array up to and with each element, in about n * block steps."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def sums(a: Column, level: int) -> Column:
        if level == 1:
            return F.transform(a, lambda x, i: total(F.slice(a, F.lit(1), i + 1)))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda j: total(F.slice(a, j * block + 1, F.lit(block))))
        inside = lambda i: total(F.slice(a, i - i % block + 1, i % block + 1))
        return let(blocks, lambda b: let(sums(b, level - 1), lambda before: F.transform(a, lambda x, i: inside(i) + F.coalesce(F.get(before, F.floor(i / block).cast("int") - 1), F.lit(0)))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(lengths, lambda a: sums(a, levels)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    step = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + step(i) - F.when(step(i) > 9, 9).otherwise(0)) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _with_spans(df: DataFrame, name: str, kind: str, pattern: Column, wanted: Column) -> DataFrame:
    """Adds an array of the pattern's spans in ``text``: matches, and the texts between them, give the places."""
    none = F.array().cast("array<string>")
    df = df.withColumn("m", F.when(wanted, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(none))
    df = df.withColumn("gaps", F.when(F.size("m") > 0, F.split("text", pattern, -1)).otherwise(none))
    df = df.withColumn("len", F.zip_with("m", F.slice("gaps", F.lit(1), F.size("m")), lambda m, g: F.length(m) + F.length(g)))
    df = df.withColumn("ends", running(F.col("len")))
    spans = F.zip_with("m", "ends", lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), m.alias("text")))
    return df.withColumn(name, F.filter(spans, lambda s: _holds(kind, s["text"]))).drop("m", "gaps", "len", "ends")


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base): base spans by start, then kind as listed."""
    df = documents(docs)
    for kind in KINDS:
        df = _with_spans(df, kind, kind, F.lit(PATTERNS[kind]), NEEDS[kind](F.col("text"), F.lit(NEEDED[kind])))
    both = F.concat(*KINDS)
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("b"), s["end"].alias("c"), s.alias("span"))))
    return df.select("doc_id", "text", F.transform(keyed, lambda x: x["span"]).alias("base"))


def entity(span: Column) -> Column:
    """What a base match stands for, however it is written."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), _digits(span["text"])).otherwise(F.lower(span["text"])))


def entities(span: Column) -> Column:
    """The entity of a base match, and the classes it belongs to: its kind, and a mail domain or the head of a number."""
    kind, digits = span["kind"], _digits(span["text"])
    head = F.when(kind == "email", F.lower(F.substring_index(span["text"], "@", -1))).when(kind == "ip", F.substring_index(span["text"], ".", 2)).when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    return F.array(entity(span), F.concat(kind, F.lit(" of "), head), F.concat(kind, F.lit("s")))


def holders(docs: DataFrame) -> DataFrame:
    """(text_hash, entities, words) of documents that may hold base spans; the words are distinct and in lower case."""
    likely = F.lit(False)
    for kind in KINDS:
        likely = likely | NEEDS[kind](F.col("text"), F.lit(NEEDED[kind]))
    outside = F.regexp_replace("text", "|".join(f"(?:{PATTERNS[k]})" for k in KINDS), "\n")
    named = F.array_distinct(F.flatten(F.transform("base", entities)))
    return base_spans(documents(docs).where(likely)).where(F.size("base") > 0).select(F.md5(F.col("text").cast("binary")).alias("text_hash"), named.alias("entities"), _words(outside).alias("words"))


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), NO_WORD)), lambda w: w != "")


def _held(df: DataFrame, text: Column) -> DataFrame:
    """``df`` for a broadcast if its rows, and the bytes of ``text`` in them, are few; counted, not guessed."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def _among(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of (term, ...) joined with ``terms`` by term.  Beyond a broadcast's bounds, a bitmap drops nearly all other words before the shuffle."""
    held = _held(terms, F.col("term"))
    if held is terms:
        bit = F.pmod(F.xxhash64("term"), F.lit(BITMAP))
        bits = terms.select(F.floor(bit / 64).alias("_word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(term), 64) as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
        words = words.withColumn("_word", F.floor(bit / 64)).join(F.broadcast(bits), "_word")  # BITMAP / 64 rows at most
        words = words.where(F.expr("_bits & shiftleft(1L, cast(pmod(xxhash64(term), 64) as int)) <> 0")).drop("_word", "_bits")
    return words.join(held, "term")


def disclosing_terms(docs: DataFrame, held: DataFrame, generalise: float = 0.85, prior: float = 1.0) -> DataFrame:
    """(term, entity_group, disclosure): terms whose share of an entity's information is at least ``generalise``.

    ``entity_group`` stands for all entities that are held by the same texts.
    """
    n_docs = docs.count()
    texts = written(held.groupBy("text_hash").agg(F.count("*").alias("n"), F.first("entities").alias("entities"), F.first("words").alias("words")), "pii-texts")
    seen = texts.select("text_hash", "n", F.explode("entities").alias("entity"))
    group = F.md5(F.concat_ws(" ", F.count("*"), F.bit_xor(F.xxhash64("text_hash")), F.bit_xor(F.xxhash64(F.lit("2"), F.col("text_hash")))))
    known = seen.groupBy("entity").agg(group.alias("entity_group"), F.sum("n").alias("n_entity")).where(F.col("n_entity") < n_docs)
    groups = written(seen.join(known, "entity").select("text_hash", "entity_group", "n_entity").distinct(), "pii-groups")
    # log p(e | t) must reach (1 - generalise) * log p(e), and p(e | t) is n_entity / (n_term + prior) at most
    most = F.col("n_entity") * F.pow(F.lit(max(n_docs, 1)) / F.col("n_entity"), F.lit(1 - generalise)) - prior
    bound = groups.agg(F.max(most)).first()[0] or 0
    terms = texts.select(F.explode("words").alias("term")).distinct()
    counted = docs.select(F.explode_outer(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") <= bound)
    counted = written(counted.join(terms, "term", "left_semi"), "pii-term-counts")
    pairs = _among(texts.select("text_hash", "n", F.explode("words").alias("term")), counted).join(groups, "text_hash").where(F.col("n_term") <= most)
    pairs = pairs.groupBy("term", "n_term", "entity_group", "n_entity").agg(F.sum("n").alias("n_both"))
    share = 1 - F.log(F.col("n_both") / (F.col("n_term") + prior)) / F.log(F.col("n_entity") / F.lit(float(max(n_docs, 1))))
    return pairs.select("term", "entity_group", share.alias("disclosure")).where(F.col("disclosure") >= generalise)


def sanitise(docs: DataFrame, generalise: float = 0.85, remove: float = 0.95, prior: float = 1.0) -> DataFrame:
    """(doc_id, base, spans, sanitised): base spans, all spans with terms, and the text without them.

    Base spans become ``[KIND]``, generalised terms ``[term]``, removed ones nothing; where spans
    overlap, the one that starts first (the longer of two) is replaced and the others lie in it.
    """
    docs = documents(docs)
    held = written(holders(docs), "pii-holders")
    told = written(disclosing_terms(docs, held, generalise, prior).groupBy("term").agg(F.max("disclosure").alias("d")), "pii-disclosures")
    drop_written(held)
    text_hash = F.md5(F.col("text").cast("binary"))
    own = _among(docs.select(text_hash.alias("text_hash"), F.explode(_words(F.col("text"))).alias("term")), told).groupBy("text_hash", "term").agg(F.first("d").alias("d"))
    own = written(own.groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("told")), "pii-text-terms")
    marked = base_spans(docs).withColumn("text_hash", text_hash).join(_held(own, F.array_join(F.map_keys("told"), " ")), "text_hash", "left")
    # What looks like a base match is matched whole, so that no term is found inside of it.
    base_like = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
    pattern = F.concat(F.lit(base_like + r"|(?<![\p{L}\p{N}])(?iu:"), F.array_join(F.array_sort(F.map_keys("told")), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    marked = _with_spans(marked, "term", "term", F.coalesce(pattern, F.lit("$.")), F.col("told").isNotNull())
    order = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    terms = F.filter("term", lambda s: F.map_contains_key(F.col("told"), F.lower(s["text"])))
    keyed = F.array_sort(F.transform(F.concat("base", terms), lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("b"), s["end"].alias("c"), s.alias("span"))))
    marked = marked.withColumn("spans", F.transform(keyed, lambda x: x["span"]))
    return marked.select("doc_id", "base", "spans", _replaced(remove).alias("sanitised"))


def _cut(pieces: Column, start: Column, end: Column, size: int) -> Column:
    """The text from ``start`` to ``end`` out of its pieces of ``size`` code points."""
    a, b = F.floor(start / size).cast("int"), F.floor(end / size).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    between = F.array_join(F.slice(pieces, a + 2, b - a - 1), "")
    return F.when(a == b, F.substring(piece(a), start % size + 1, end - start)).otherwise(F.concat(F.substring(piece(a), start % size + 1, F.lit(size)), between, F.substring(piece(b), F.lit(1), end % size)))


def _replaced(remove: float, size: int = 4096) -> Column:
    """``text`` with its ``spans`` replaced.  The text is cut into pieces first, as finding a place takes time in a long string."""
    label = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(F.col("told")[F.lower(s["text"])] >= remove, F.lit("")).otherwise(F.lit("[term]"))
    none = F.array().cast("array<struct<start: int, end: int, label: string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("kept"))
    one = lambda s: F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label")))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["kept"], one(s)).alias("kept")))
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % size), F.lit(0))

    def joined(p: Column, kept: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(kept, i - 1)["end"])
        last = F.element_at(kept, -1)["end"]
        return F.concat(F.array_join(F.transform(kept, lambda s, i: F.concat(_cut(p, before(i), s["start"], size), s["label"])), ""), _cut(p, last, F.length("text"), size))

    return F.when(F.size("spans") == 0, F.col("text")).otherwise(let(pieces, lambda p: let(F.aggregate("spans", start, step, lambda acc: acc["kept"]), lambda kept: joined(p, kept))))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    """How many base spans are of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
