"""Spelling variants: words one edit apart, from forward and reversed dictionaries.

One edit leaves one half of a word intact. The forward dictionary has words by their first
half, the reversed one by their second; near words stand in one run of one of them. Entries
are sorted by run, and runs are joined with themselves. A run of too many words is subdivided:
the edit lies in the part that is still open, and leaves one half of that intact again. After
the last halving the edit has one place, and the words of a run are as many as there are letters.

Replacements pair words of one length. Insertions pair a word of n code points with words of
n + 1, which stand in the run by what deleting a code point leaves of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import scratch

#: Runs of more entries are subdivided.
RUN = 64
#: Words of fewer code points or occurrences are left out.
LEAST_CHARS, LEAST_COUNT = 5, 3
#: A near word is a word's form if it is so many times as frequent.
TIMES = 2
#: Of the occurrences' checksums those that this divides lose a code point.
SPOILT = 97
#: A form is at least twice as frequent, so a chain of forms has fewer than 64 words: six doublings reach its end.
DOUBLINGS = 6

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]+"
REPLACED, INSERTED = 0, 1


def counted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoilt: int = SPOILT, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts with their occurrences, counted before they are exchanged.

    spoilt plants misspellings: an occurrence whose crc32, with its id, is divisible by it loses the code point that the
    crc32 names. Null texts have no words; a null id counts as the empty string; repeated rows count each time."""
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("word"))
    runs = runs.withColumn("word", F.when(F.col("word").rlike("[A-Z]"), F.translate("word", UPPER, LOWER)).otherwise(F.col("word")))
    # A word that is too short before a code point goes is so after it.
    runs = runs.where(F.length("word") >= least_chars).withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "word")))
    at = (F.col("_h") % F.length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    words = runs.select(F.when(F.col("_h") % spoilt == 0, shorter).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _fixed(p: Column, s: Column) -> Column:
    """The run of an entry: what of the word lies before and after the part in which the edit is looked for."""
    return F.concat_ws(" ", "edit", "chars", p, s, F.substring("word", F.lit(1), p), F.expr("right(word, s)"))


def _halved(entries: DataFrame) -> DataFrame:
    """Each entry once in the forward and once in the reversed dictionary of its run; chars: length of the shorter word.

    The edit's place is p .. p + m - 1 of the m = chars - p - s open code points, or p .. p + m for an insertion. Places
    from the middle on leave p + half code points at the front intact, those before it the rest."""
    m = F.col("chars") - F.col("p") - F.col("s")
    half = F.when(F.col("edit") == REPLACED, F.floor(m / 2)).otherwise(F.floor((m + 1) / 2)).cast("int")
    forward = F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s"))
    behind = F.when(F.col("edit") == REPLACED, m - half).otherwise(m - half + 1).cast("int")
    reverse = F.struct(F.col("p").alias("p"), (F.col("s") + behind).alias("s"))
    cut = entries.select("edit", "longer", "chars", "word", "n", F.explode(F.array(forward, reverse)).alias("_cut"))
    cut = cut.select("edit", "longer", "chars", F.col("_cut.p").alias("p"), F.col("_cut.s").alias("s"), "word", "n")
    return cut.withColumn("run", _fixed(F.col("p"), F.col("s")))


def _near_in(runs: DataFrame) -> DataFrame:
    """Pairs of near words of the same run, each pair in one run only."""
    a = runs.select("run", "edit", "longer", "chars", "s", F.col("word").alias("a"), F.col("n").alias("a_n")).where("not longer")
    b = runs.select("run", F.col("longer").alias("b_longer"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    pairs = a.hint("merge").join(b, "run")
    replaced = (F.col("edit") == REPLACED) & (F.col("a") < F.col("b"))
    # Where a letter is doubled an insertion has several places. The last counts: the words differ right after it.
    end = F.col("chars") - F.col("s") + 1
    last = (F.col("s") == 0) | (F.substring("a", F.lit(1), end) != F.substring("b", F.lit(1), end))
    inserted = (F.col("edit") == INSERTED) & F.col("b_longer") & last
    return pairs.where((replaced | inserted) & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, run: int = RUN) -> DataFrame:
    """a, a_n, b, b_n: all pairs of words (word, n; distinct) that differ by one inserted, deleted or replaced code point,
    each once."""
    length = F.length("word")
    roles = F.array(
        *[F.struct(F.lit(edit).alias("edit"), F.lit(longer).alias("longer"), chars.alias("chars")) for edit, longer, chars in ((REPLACED, False, length), (INSERTED, False, length), (INSERTED, True, length - 1))]
    )
    entries = words.where(length > 0).select("word", "n", F.explode(roles).alias("_r")).select("_r.edit", "_r.longer", "_r.chars", F.lit(0).alias("p"), F.lit(0).alias("s"), "word", "n")
    found = []
    while True:
        entries, _ = scratch(_halved(entries), "spelling-entries")
        # One open code point of a replacement and none of an insertion can't be halved.
        open_chars = F.col("chars") - F.col("p") - F.col("s") - F.when(F.col("edit") == REPLACED, 1).otherwise(0)
        sizes = entries.where(open_chars > 0).groupBy("run").count().where(F.col("count") > run).select("run")
        large, _ = scratch(sizes, "spelling-large")
        if large.isEmpty():
            found.append(_near_in(entries))
            break
        found.append(_near_in(scratch(entries.join(large, "run", "left_anti"), "spelling-runs")[0]))
        entries = entries.join(large, "run", "left_semi").drop("run")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms (word, form) ends, by doubling the steps that a row has made."""
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        step = reached.join(reached.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left")
        reached, _ = scratch(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        if reached.where("_moved").isEmpty():
            break
        reached = reached.drop("_moved")
    return reached.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, run: int = RUN) -> DataFrame:
    """One row for each row of words (word, n; distinct): word, form, root, n, n_near, form_n.

    form is the near word of largest n (of equal ones the smallest by code points) if that is at least `times` (2 or
    more) the word's n, else null; root is where following forms ends, the word itself if it has none. Null words are
    left out. Other columns are not read."""
    if times < 2:
        raise ValueError("a form is at least twice as frequent")
    words, _ = scratch(words.where("word is not null").select("word", "n"), "spelling-words")
    pairs, _ = scratch(near_words(words, run), "spelling-pairs")
    sides = F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in (("a", "b"), ("b", "a"))])
    links = pairs.select(F.explode(sides).alias("_l")).select("_l.*")
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("_best"))
    far = F.col("_best.n") * -1 >= F.col("n") * times
    joined = words.join(best, "word", "left")
    out, _ = scratch(joined.select("word", F.when(far, F.col("_best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, -F.col("_best.n")).alias("form_n")), "spelling-forms")
    roots = _roots(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(df: DataFrame) -> DataFrame:
    """variants() of the words of documents as counted() has them. Texts may be null or empty; a table without words gives
    no rows; other columns are not read."""
    return variants(counted(df))


ORACLE = """
with recursive crc as (
    select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) as r(i)),
runs as (
    select doc_id, word, count(*) as k from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as word from documents) group by all),
hashed as (
    select word, k, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(hex(s)) // 2 + 1), lambda i: ('0x' || substr(hex(s), 2 * i - 1, 2))::bigint)),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) as h
    from (select *, coalesce(doc_id::varchar, '') || ':' || word as s from runs where length(word) >= 5), crc),
words as (
    select word, sum(k)::bigint as n
    from (select case when h % 97 = 0 then substr(word, 1, (h % length(word))::int) || substr(word, (h % length(word))::int + 2) else word end as word, k from hashed)
    where length(word) >= 5 group by word having sum(k) >= 3),
cut as (select word, n, i, substr(word, 1, i::int - 1) || substr(word, i::int + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
links as (
    select a.word, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select b.word, a.word, a.n from cut a join words b on a.rest = b.word
    union select a.word, b.word, b.n from cut a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, min({'n': -other_n, 'w': other}) as best from links group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -best.n >= 2 * w.n then best.w end as form, case when -best.n >= 2 * w.n then -best.n end as form_n from words w left join best b on w.word = b.word),
chain as (
    select word, word as at from forms where form is null
    union all select f.word, c.at from forms f join chain c on f.form = c.word)
select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n from forms f join chain c on f.word = c.word
"""
