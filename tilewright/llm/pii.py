"""Information-theoretic sanitisation, in DataFrame functions only.

Patterns find the protected entities (mail addresses, IP addresses, card and phone
numbers). An entity counts for itself and for its group: the addresses of a mail host, of a
/16 network, the cards of an issuer, the numbers of an area. Corpus co-occurrence then tells
which other terms give an entity away. Counts are of different documents, all of them and
exact: n(e) mention entity e, n(t) hold term t, n(e,t) hold t within WINDOW characters of a
mention of e, whatever lines they are on, and N is all. t discloses e as far as PMI(e; t) =
ln(N n(e,t) / (n(e) n(t))) comes near the entity's information IC(e) = ln(N / n(e)), which it
reaches when t never stands anywhere else. Terms with PMI >= SHARE * IC that SUPPORT different
documents have so are spans of kind term in the documents that mention e: there the entity's
own removal would not hide it. One document proves nothing, however rare its words are.
Documents without e keep the term. Equal texts are one document, so that copying a document
proves nothing either; near copies are different documents, unless they have been removed
before, as in the pipeline. Terms are generalised to what they are: a number or a term, or by
class a number, a code of letters and digits, a name (a capital first) or another term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import quoted, scratch

SHARE = 0.95
SUPPORT = 2
#: Code points on either side of an entity in which terms count as standing with it.
WINDOW = 100
#: One document in so many gives a lower bound of n(t), by which common terms are left out before exact counting.
BOUND = 16
#: So many terms are sent to every task; more are joined by exchange.
SENT = 100_000

# The kinds in their order and what they look like. A lookbehind or \G (the last match's end) lets a
# search that fails at the start of a run of characters not try again at each of them; what is found stays the same.
KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
_TERM = r"[\p{L}\p{N}]{2,}"


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(_IP)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _only_valid(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _located(text: Column, pattern: Column, found: Column, kind: int) -> Column:
    """Spans of the matches: what lies between them comes from splitting at the same pattern."""
    between = F.split(text, pattern, -1)
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

    pairs = F.zip_with(F.slice(between, 1, F.greatest(F.size(found), F.lit(1))), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, state, step, lambda acc: acc["spans"])).otherwise(F.array().cast(SPAN))


def base_spans(df: DataFrame, text_col: str = "text", out: str = "base") -> DataFrame:
    """Adds the valid spans of all kinds by start, then kind; kind is a number in the order of KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    for k, p in PATTERNS.items():
        found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        df = df.withColumn(f"_{k}", F.when(gate[k], found).otherwise(F.array().cast("array<string>")) if k in gate else found)
    for i, k in enumerate(PATTERNS):
        spans = _located(text, F.lit(PATTERNS[k]), F.col(f"_{k}"), i)
        df = df.withColumn(f"_{k}", _only_valid(k, spans))
    return df.withColumn(out, F.array_sort(F.concat(*[F.col(f"_{k}") for k in PATTERNS]))).drop(*[f"_{k}" for k in PATTERNS])


def entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"].cast("string"), F.lower(span["value"]))


def keys_of(span: Column) -> Column:
    """Keys of an entity and of its group."""
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    host = F.concat(F.lit("@"), F.substring_index(F.lower(span["value"]), "@", -1))
    net = F.concat(F.substring_index(span["value"], ".", 2), F.lit(".*"))
    issuer, area = F.concat(F.substring(digits, 1, 6), F.lit("*")), F.concat(F.lit("+"), F.substring(digits, F.lit(1), F.length(digits) - 7), F.lit("*"))
    group = F.when(span["kind"] == 0, host).when(span["kind"] == 1, net).when(span["kind"] == 2, issuer).otherwise(area)
    return F.array(entity(span), F.concat_ws(":", span["kind"].cast("string"), F.concat(F.lit("~"), group)))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def _standing_with(text: Column, base: Column) -> Column:
    r"""Distinct "entity\nterm" of a text, and "entity\n" for each entity, and likewise for its group: terms in the window
    of a mention, without words that its ends cut."""
    def near(s: Column) -> Column:
        start = F.greatest(s["start"] - WINDOW - 1, F.lit(0))
        before = F.substring(text, (start + 1).cast("int"), (s["start"] - start).cast("int"))
        before = F.when(start > 0, F.regexp_replace(before, r"^[\p{L}\p{N}]+", "")).otherwise(before)
        after = F.substring(text, (s["end"] + 1).cast("int"), F.lit(WINDOW + 1))
        after = F.when(s["end"] + WINDOW + 1 < F.length(text), F.regexp_replace(after, r"[\p{L}\p{N}]+$", "")).otherwise(after)
        terms = F.concat(F.array(F.lit("")), _terms(F.concat_ws(" ", before, after)))
        return F.transform(terms, lambda t: F.transform(keys_of(s), lambda e: F.concat(e, F.lit("\n"), t)))

    return F.array_distinct(F.flatten(F.flatten(F.transform(base, near))))


def _key(text: str, id_col: str) -> Column:
    """A digest of id and text in which null and empty ids differ."""
    return F.md5(F.concat_ws(":", F.when(F.col(id_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(F.col(id_col).cast("string")))), F.col(id_col).cast("string"), F.col(text)))


def _with_entities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, h, base, pairs, tokens) of the different rows that mention an entity, as a scratch table: keys of the row and
    of its text, its spans, _standing_with and the hashes of its terms."""
    texts = df.select(_key(text_col, id_col).alias("k"), F.md5(text_col).alias("h"), F.col(text_col).alias("t")).where(F.col("t").rlike("[0-9@]"))
    found = base_spans(texts, "t").where(F.size("base") > 0)
    found = found.select("k", "h", "base", _standing_with(F.col("t"), F.col("base")).alias("pairs"), F.transform(_terms(F.col("t")), lambda t: F.xxhash64(t)).alias("tokens"))
    return scratch(found.dropDuplicates(["k"]), "pii-entities")[0]


def _disclosing(docs: DataFrame, entities: DataFrame, share: float, support: int, groups: bool) -> DataFrame:
    """(entity, term) above the threshold, from the texts of docs (column t) and _with_entities of them."""
    pairs = entities.select("h", "pairs").dropDuplicates(["h"]).select(F.explode("pairs").alias("pair"))
    counted = pairs.groupBy("pair").agg(F.count("*").alias("n"))
    counted, _ = scratch(counted.select(F.substring_index("pair", "\n", 1).alias("entity"), F.substring_index("pair", "\n", -1).alias("term"), "n"), "pii-pairs")
    counted = counted if groups else counted.where(~F.col("entity").rlike("^[0-9]:~"))
    n_e = counted.where("term = ''").select("entity", F.col("n").alias("n_e"))
    n_et = counted.where((F.col("term") != "") & (F.col("n") >= support)).select("entity", "term", F.col("n").alias("n_et")).join(n_e, "entity")
    n = float(docs.select(F.md5("t")).distinct().count())
    # PMI >= share * IC says in how many documents a term may stand at most; a little more, for rounding.
    n_et, _ = scratch(n_et.withColumn("most", F.col("n_et") * F.pow(F.lit(n) / F.col("n_e"), 1 - share) * 1.000001), "pii-known")
    candidates, _ = scratch(n_et.groupBy("term").agg(F.max("most").alias("most")), "pii-candidates")
    texts = docs.select(F.md5("t").alias("h"), "t")

    def holders(texts: DataFrame, terms: DataFrame) -> DataFrame:
        held = texts.select("h", F.explode(_terms(F.col("t"))).alias("term")).join(_sent(terms), "term")
        return held.groupBy("term", "most").agg(F.countDistinct("h").alias("n_t"))

    some = holders(texts.where(F.pmod(F.xxhash64("h"), F.lit(BOUND)) == 0), candidates)
    common = some.where(F.col("n_t") > F.col("most")).select("term")
    rare, _ = scratch(candidates.join(common, "term", "left_anti"), "pii-rare")
    n_t = holders(texts, rare).select("term", "n_t")
    pmi, ic = F.log(F.lit(n) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))), F.log(F.lit(n) / F.col("n_e"))
    return n_et.join(n_t, "term").where((pmi >= share * ic) & (ic > 0)).select("entity", "term")


def _sent(small: DataFrame) -> DataFrame:
    """A written table, for a join: sent to every task only if it has few rows."""
    return F.broadcast(small) if small.count() <= SENT else small


def disclosing(docs: DataFrame, share: float = SHARE, support: int = SUPPORT, groups: bool = False) -> DataFrame:
    """(entity, term) above the threshold, from the column text of docs, of entities alone or of their groups too; null
    texts count for nothing."""
    texts = docs.select(F.col("text").alias("t")).where(F.length("t") > 0)
    return _disclosing(texts, _with_entities(texts.withColumn("i", F.lit(0)), "i", "t"), share, support, groups)


def _with_spans(df: DataFrame, id_col: str, text_col: str, share: float, support: int) -> DataFrame:
    """(row, t, base, spans): each row of df as a struct, its text (null: empty), its spans by start and kind."""
    texts = df.select(F.col(text_col).alias("t")).where(F.length("t") > 0)
    entities = _with_entities(df, id_col, text_col)
    known, _ = scratch(_disclosing(texts, entities, share, support, True).select("entity", "term", F.xxhash64("term").alias("token")), "pii-terms")
    # A row's own terms among the known ones, then those whose entity is the row's too.
    held = entities.select("k", F.explode("tokens").alias("token")).join(_sent(known), "token").select("k", "entity", "term")
    own = entities.select("k", F.explode(F.array_distinct(F.flatten(F.transform("base", keys_of)))).alias("entity"))
    terms = held.join(own, ["k", "entity"]).groupBy("k").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    found, _ = scratch(entities.select("k", "base").join(terms, "k", "left"), "pii-found")
    rows = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), _key(text_col, id_col).alias("k"))
    # Texts with neither a digit nor an @ have no entities: they stay where they are.
    plain = rows.where(~F.col("t").rlike("[0-9@]")).select("row", "t", F.lit(None).cast(SPAN).alias("base"), F.lit(None).cast("array<string>").alias("terms"))
    joined = rows.where(F.col("t").rlike("[0-9@]")).join(found, "k", "left").select("row", "t", "base", "terms")
    out = joined.unionByName(plain).withColumn("base", F.coalesce("base", F.array().cast(SPAN)))
    out = out.withColumn("free", F.when(F.col("terms").isNotNull(), F.filter(_term_spans(F.col("t"), F.col("terms")), lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))))
    return out.select("row", "t", "base", F.when(F.col("free").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "free"))).alias("spans"))


def _term_spans(text: Column, terms: Column) -> Column:
    """Spans of the words of a text that are among the terms."""
    word = F.lit(r"[\p{L}\p{N}]+")
    pairs = F.zip_with(F.split(text, word, -1), F.regexp_extract_all(text, word, F.lit(0)), lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index("term")).alias("kind"), end.alias("end"), x["value"].alias("value"))
        more = F.when(F.array_contains(terms, F.lower(x["value"])), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), more.alias("spans"))

    return F.aggregate(pairs, state, step, lambda acc: acc["spans"])


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """df with `base` (the patterns' spans) and `spans` (the disclosing terms too), both by start and kind.

    Null and empty texts have no spans. Rows, ids and further columns stay as they are, repeated rows too; columns
    that are named base or spans already are replaced."""
    out = _with_spans(df, id_col, text_col, share, support)
    return out.select(*[F.col(f"row.{quoted(c)}") for c in df.columns if c.lower() not in ("base", "spans")], "base", "spans")


def sanitised(text: Column, spans: Column, by_class: bool = False) -> Column:
    """The text with each span generalised to its kind in brackets, terms to what they look like; of spans that overlap the
    first names all."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        looks = [(r"^\p{N}+$", "[NUMBER]"), (r"\p{N}", "[CODE]"), (r"^\p{Lu}", "[NAME]")][: None if by_class else 1]
        term = F.coalesce(*[F.when(s["value"].rlike(p), F.lit(name)) for p, name in looks], F.lit("[TERM]"))
        name = F.when(s["kind"] == KINDS.index("term"), term).otherwise(F.element_at(names, s["kind"] + 1))
        more = F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), name)
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), more.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    rest = F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, support: int = SUPPORT, by_class: bool = False) -> DataFrame:
    """df with its texts sanitised, terms by class if so asked. Null texts stay null; rows, ids and all further columns stay, repeated rows too."""
    out = _with_spans(df, id_col, text_col, share, support)
    text = F.when(F.col(f"row.{quoted(text_col)}").isNotNull(), sanitised(F.col("t"), F.col("spans"), by_class))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"row.{quoted(c)}") for c in df.columns])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(df: DataFrame) -> DataFrame:
    """One row for each row of df: doc_id, the number of each kind, the digest of base spans, all spans, n_terms.

    Null and empty texts have no spans; null ids and repeated rows get their own rows; other columns are not read."""
    a = annotate(df.select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return a.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index("term"))).cast("long").alias("n_terms"))
