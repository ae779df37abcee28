"""Spelling variants by full neighbourhood generation (operator 12).

For every word all distinct results of one deletion, replacement or insertion
over the observed alphabet are made; one that is a word of the vocabulary is a
near word, found by a hash join and without any distance. Distinct by rule: of
a run of equal letters one is deleted, a letter isn't replaced by itself, and
none is inserted behind its equal.

A candidate is a hash, made in a few operations from the hashes of the parts
that stay, so that a word of m letters costs m times the alphabet, not m
strings as long as itself. A filter of fixed size (8 MB) holds the
vocabulary's hashes: what it rules out isn't shuffled. It fills up as the
vocabulary grows; then more candidates reach the join, which decides. The
candidate's string is compared with the word it meets, as hashes may collide.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTables, hash_filter, in_filter, mix64

#: Candidates that are made at a time.
CANDIDATES = 1 << 17
#: Letters of words times alphabet that one task works on.
TASK = 20_000_000
#: Odd, so that it has an inverse among the 64-bit numbers.
BASE = 0x9E3779B97F4A7C1B
INVERSE = pow(BASE, -1, 1 << 64)


def powers(n: int) -> np.ndarray:
    """1, BASE, BASE^2, ... of n numbers."""
    out = np.full(max(n, 1), np.uint64(BASE))
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def letters(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32)


def weights(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def word_hash(word: str) -> int:
    """The sum over letters of weight times BASE^place, mixed."""
    codes = letters(word)
    return int(mix64(np.atleast_1d((weights(codes) * powers(len(codes))).sum(dtype=np.uint64)))[0])


def neighbourhoods(words: list[str], alphabet: np.ndarray, size: int = CANDIDATES):
    """(hashes, numbers of words, places, letters put in or 0, letters taken out 0 or 1) of all distinct strings one edit away, in parts.

    words: of one length.
    """
    m = len(words[0])
    codes = letters("".join(words)).reshape(-1, m)
    power, new = powers(m + 1), weights(alphabet)
    own = weights(codes) * power[:m]
    before = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(own, axis=1, dtype=np.uint64)], axis=1)
    total = before[:, -1:]
    last = np.concatenate([np.zeros((len(words), 1), np.uint32), codes], axis=1)  # the letter before each place
    k, at = np.nonzero(codes != last[:, :-1])
    yield mix64(before[k, at] + (total[k, 0] - before[k, at + 1]) * np.uint64(INVERSE)), k, at, np.zeros(len(at), np.uint32), 1
    with_letter = before + (total - before) * np.uint64(BASE)
    step = max(1, size // max(1, len(alphabet)))
    for low in range(0, len(words) * (m + 1), step):
        k, place = np.divmod(np.arange(low, min(low + step, len(words) * (m + 1))), m + 1)
        lifted = new[None, :] * power[place][:, None]
        fit = alphabet[None, :] != last[k, place][:, None]
        i, x = np.nonzero(fit)
        yield mix64((with_letter[k, place][:, None] + lifted)[fit]), k[i], place[i], alphabet[x], 0
        inner = place < m
        k, place, lifted = k[inner], place[inner], lifted[inner]
        fit = alphabet[None, :] != codes[k, place][:, None]
        i, x = np.nonzero(fit)
        yield mix64(((total[k, 0] - own[k, place])[:, None] + lifted)[fit]), k[i], place[i], alphabet[x], 1


def _hashed(batches):
    for batch in batches:
        words = batch.column(batch.schema.get_field_index("word"))
        hashes = np.asarray([word_hash(w) for w in words.to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), words, batch.column(batch.schema.get_field_index("n")), pa.array(hashes, pa.int64())], names=["id", "word", "n", "hash"])


def _candidates(filled: np.ndarray, alphabet: np.ndarray):
    def run(batches):
        for batch in batches:
            ids, words = (batch.column(batch.schema.get_field_index(x)) for x in ("id", "word"))
            ids, words = ids.to_numpy(), words.to_pylist()
            alike = {}
            for k, word in enumerate(words):
                alike.setdefault(len(word), []).append(k)
            for rows in alike.values():
                number = ids[rows]
                for hashes, k, place, letter, taken in neighbourhoods([words[x] for x in rows], alphabet):
                    at = np.flatnonzero(in_filter(filled, hashes))
                    put = pa.array([chr(x) if x else "" for x in letter[at].tolist()], pa.string())
                    columns = [pa.array(number[k[at]]), pa.array(hashes[at].view(np.int64)), pa.array(place[at].astype(np.int32)), put, pa.array(np.full(len(at), taken, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "hash", "place", "letter", "taken"])

    return run


def spelling_variants(words: DataFrame, times: int = 10, tables: WorkTables | None = None) -> DataFrame:
    """One row per word of words (word, n): word, form, root, n, n_near, form_n.

    form: the near word of largest n (ties: smallest in code-point order), if
    its n is at least `times` the word's; else null. root: the last word on the
    way from form to form, the word itself without one. Words may be of any
    length and letters. Repeated words are one, with the sum of their n. Rows of
    null or empty words or null n are left out. Other columns are not read. An
    empty table gives no rows.
    """
    tables = tables or WorkTables(words.sparkSession, "variants")
    once = words.where("word IS NOT NULL AND word <> '' AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    listed = tables.save(once.withColumn("id", F.monotonically_increasing_id()), "listed")
    vocabulary = tables.save(listed.mapInArrow(_hashed, "id long, word string, n long, hash long"), "words")
    alphabet = np.unique(letters("".join(r[0] for r in vocabulary.select(F.explode(F.split("word", ""))).distinct().collect())))
    filled = hash_filter(vocabulary.select("hash"))

    # few bytes make very many candidates: tasks by the work, not by the size
    work = (vocabulary.agg(F.sum(F.char_length("word"))).first()[0] or 0) * len(alphabet)
    dealt = vocabulary.select("id", "word").repartition(int(work // TASK) + 1, "id")
    kept = dealt.mapInArrow(_candidates(filled, alphabet), "id long, hash long, place int, letter string, taken int")
    other = vocabulary.select("hash", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = kept.join(other, "hash").join(vocabulary.select("id", "word"), "id")
    made = F.concat(F.expr("substring(word, 1, place)"), "letter", F.expr("substring(word, place + taken + 1)"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = met.where(made == F.col("near")).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    largest = -F.col("best.less")
    strong = largest >= F.col("n") * times
    found = vocabulary.select("id", "word", "n").join(near, "id", "left")
    forms = found.select("word", F.when(strong, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, largest).alias("form_n"))
    forms = tables.save(forms, "forms")

    # a form has `times` the n of its word, so ways are short and end; each round doubles what is followed
    roots = tables.save(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = tables.save(moved, "roots")
        tables.drop(roots)
        roots = moved.select("word", "root")
        roots.work_path = moved.work_path
        if moved.where("moved").isEmpty():
            break
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def counted_words(docs: DataFrame, least: int = 7, times: int = 2, spoiled: int = 31) -> DataFrame:
    """(word, n) of the runs of letters of whole texts, A-Z lower-cased.

    Of a run whose checksum with the doc_id `spoiled` divides, one letter is
    left out. Words have at least `least` letters and occur `times` times or
    more. Null texts have no runs; a null doc_id counts as an empty one.
    """
    # a run that is short enough to end below `least` letters is never needed
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\u00C0-\u00FF]{{{least},}}"), F.lit(0))).alias("run")
    )
    low = runs.select("doc_id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    summed = low.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    placed = summed.withColumn("at", (F.col("h") % F.char_length("run")).cast("int"))
    word = F.when(F.col("h") % spoiled == 0, F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
    return placed.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def variant_digest(docs: DataFrame) -> DataFrame:
    """spelling_variants of counted_words of documents."""
    tables = WorkTables(docs.sparkSession, "variants")
    return spelling_variants(tables.save(counted_words(docs), "counted"), tables=tables)


SQL = """
WITH RECURSIVE steps AS (
  SELECT range AS byte, 0 AS k, range::BIGINT AS c FROM range(256)
  UNION ALL SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), grouped AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))) AS h
  FROM grouped, crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS rest, length(word) AS m FROM words, range(1000000) r(i) WHERE i < length(word)
), holes AS (SELECT word, n, i, substr(word, 1, i) || '?' || substr(word, i + 2) AS hole FROM words, range(1000000) r(i) WHERE i < length(word)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b USING (hole) WHERE a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest
), best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN top END AS form_n,
    CASE WHEN top >= 10 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = top) END AS form
  FROM words w LEFT JOIN best USING (word)
), way AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT way.word, form FROM way JOIN forms ON forms.word = way.at WHERE form IS NOT NULL
)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM forms f JOIN way ON way.word = f.word JOIN forms e ON e.word = way.at AND e.form IS NULL
"""
