"""Finding and repairing text that was decoded with the wrong character encoding.

1. *Words*: the distinct words with characters beyond ASCII, and in how many
   different texts each stands, are counted (copies of a text count once); a
   task counts its own texts first.
   Digits do not tell words apart. Also the distinct runs of such characters
   inside the words, so that a word that is rare or stands beside a name nobody
   else uses is covered by its runs.
2. *Forms*: every distinct word and run is put through all encoding chains (see
   `encodings`), which gives a table of garbled forms. Forms that no word of the
   corpus equals are dropped where they are made, by a bit table of the words,
   whose size is fixed; what it lets through by chance goes in the join.
3. *Join*: words of the corpus that equal a form are garbled. A `wide` form
   settles it; of two words that could each be the other's form, the one that
   stands in a quarter of the other's texts or fewer is the garbled one, and
   what that leaves open goes by the words beside them (`_by_neighbours`);
   a run of replacement characters always is.
4. Spans of ASCII that were read as UTF-16 have no word limits. They are turned
   back, and count if their inner words are words of the corpus.
5. *Documents*: their words are joined with the garbled ones; repair replaces
   each by the clean word that it is the form of. A lossy form is only replaced
   if a single clean word of the corpus gives it.

All joins are hash joins between distinct words, which are few; documents only
meet the garbled words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.encodings import ASCII_PAIR, QUESTION, REPLACED, RUN, SPACE, WORD_BREAK, forms_and_chains, normal, utf16_text, with_digits
from strandwise.runtime import checkpointed, small_side

#: How many times as many texts settle at once which of two interchangeable words is the clean one.
CLEAN_RATIO = 4
#: Characters from which on a word, or a run, is hardly another's form by chance.
LONG = 3
#: Distinct words that a task holds before it passes them on.
HELD_WORDS = 200_000
#: Distinct words and runs a task makes forms of, and the least number of tasks.
FORM_WORDS, FORM_TASKS = 1_000, 64
#: The bit table of corpus words has 2**22 bits, whatever the corpus.
FILTER_BITS = 22


def words_of(text: str) -> list[str]:
    for mark in SPACE[1:]:
        if mark in text:
            text = text.replace(mark, " ")
    return text.split(" ")


def _suspects(words: set[str]) -> set[str]:
    """Normalised words that can be a garbled form at all, or have one."""
    return {normal(w) for w in words if not w.isascii() or ("?" in w and QUESTION.search(w))}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> word, documents; 0 documents for a plain word of ASCII letters."""
    found: dict[str, int] = {}
    plain: set[str] = set()

    def rows() -> pa.RecordBatch:
        for w in plain:
            if len(w) > 2 and w.isalpha() and w.isascii():
                found.setdefault(w, 0)
        out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "docs"])
        found.clear()
        plain.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = set(words_of(text))
            for w in _suspects(words):
                found[w] = found.get(w, 0) + 1
            plain |= words
            if len(found) > HELD_WORDS or len(plain) > 2 * HELD_WORDS:
                yield rows()
    if found or plain:
        yield rows()


def _mention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, word: the distinct suspects of each document."""
    for batch in batches:
        at, words = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = _suspects(set(words_of(text)))
            at += [i] * len(own)
            words += own
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.string())], ["id", "word"])


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, word, odd: the distinct suspects of each text, and how many there are; copies are left out as far as a task sees them."""
    seen: set[bytes] = set()
    for batch in batches:
        at, words, odd = [], [], []
        for i, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key in seen:
                continue
            if len(seen) >= HELD_WORDS:
                seen.clear()
            seen.add(key)
            own = _suspects(set(words_of(text)))
            at += [i] * len(own)
            words += own
            odd += [len(own)] * len(own)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.string()), pa.array(odd, pa.int64())], ["id", "word", "odd"])


def _filter(units: DataFrame) -> bytes:
    """The bit table of the words: at most `2**16` rows of 64 bits reach the driver."""
    bit = F.crc32(F.col("word").cast("binary")).bitwiseAND((1 << FILTER_BITS) - 1)
    slots = units.select(F.shiftright(bit, 6).alias("slot"), F.expr("shiftleft(1L, cast(crc32(cast(word as binary)) & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for slot, bits in slots.collect():
        table[slot] = bits
    return table.astype("<i8").tobytes()


def _forms(words):
    """word, docs, is_run -> form, word, docs, is_run, chain, kind, chains, of the forms that the bit table `words` lets through."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask, crc = words.value, (1 << FILTER_BITS) - 1, zlib.crc32
        for batch in batches:
            rows: list[tuple] = []
            for word, docs, is_run in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for form, (chain, kind, chains) in forms_and_chains(word, is_run).items():
                    at = crc(form.encode()) & mask
                    if table[at >> 3] >> (at & 7) & 1:
                        rows.append((form, word, docs, is_run, chain, kind, chains))
            if rows:
                *most, chains = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in most], pa.array(chains, pa.list_(pa.string()))], ["form", "source", "source_docs", "form_is_run", "chain", "kind", "chains"])

    return of


def _turned_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """word -> word, repaired, inner: each inner word of the ASCII that UTF-16 made of it; null if there is none."""
    for batch in batches:
        rows = []
        for word in batch["word"]:
            spans = {r: t for r in ASCII_PAIR.findall(word) if (t := utf16_text(r)) is not None}
            if not spans:
                continue
            repaired = ASCII_PAIR.sub(lambda m, spans=spans: spans.get(m.group(), m.group()), word)
            inner = {w for t in spans.values() for w in WORD_BREAK.split(t)[1:-1] if len(w) > 2 and w.isalpha()}
            rows += [(word, repaired, w) for w in inner or {None}]
        yield pd.DataFrame(rows, columns=["word", "repaired", "inner"])


def _put_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """word, runs, sources, chain -> word, source, chain: the word with its runs replaced, null if one of the garbled runs has no source."""
    for batch in batches:
        out = []
        for word, runs, sources in zip(batch["word"], batch["runs"], batch["sources"], strict=True):
            known = dict(zip(runs, sources, strict=True))
            whole = all(s is not None for s in known.values())
            out.append(RUN.sub(lambda m, known=known: known.get(m.group(), m.group()), word) if whole else None)
        yield pd.DataFrame({"word": batch["word"], "source": out, "chain": batch["chain"]})


def _by_neighbours(texts: DataFrame, hits: DataFrame, clear: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which of the words that numbers of texts leave open are garbled, by the other words of their texts.

    A garbled stretch has all its words through one chain. For each word that is
    a form under a chain, the share of the other words of its texts that are
    forms under it too is taken; it is garbled if there is any in at least half
    of its texts, and the share is above that of its counterpart under the chain
    the other way round. Words of fewer than `LONG` characters and words that
    are only forms run by run are garbled if half of their texts or more hold
    another word that is so under the chain.

    Out: `word`, `source`, `chain` of whole words, and the same of those that went by short words or runs.
    """
    other_way = clear.select(F.col("source").alias("word"), F.col("word").alias("source"), "is_run")
    same = hits.where("kind = 'same'").join(other_way, ["word", "source", "is_run"], "left_anti")
    named = checkpointed(same.select("word", "source", "is_run", "docs", "source_docs", F.explode("chains").alias("chain")).withColumn("back", F.expr("array_join(reverse(split(chain, '>')), '>')")))
    whole = named.where("not is_run")
    certain = F.when(F.char_length("run") < LONG, F.col("source_docs") > F.col("run_docs")).otherwise(F.col("source_docs") >= F.col("run_docs"))
    by_run = runs.select("word", "run").join(named.where("is_run").select(F.col("word").alias("run"), "source", F.col("docs").alias("run_docs"), "source_docs", "chain"), "run").where(certain)
    by_run = by_run.groupBy("word", "run", "chain").agg(F.min("source").alias("source")).groupBy("word", "chain").agg(F.collect_list("run").alias("runs"), F.collect_list("source").alias("sources"))
    by_run = by_run.join(runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word").where(F.size("runs") == F.col("n")).drop("n")
    by_run = checkpointed(by_run)

    is_long = F.char_length("word") >= LONG
    short = whole.where(~is_long & (F.col("source_docs") > F.col("docs"))).groupBy("word", "chain").agg(F.min("source").alias("source"))
    # Shares are asked for long words, and for their sources, which may be short.
    weighed = whole.where(is_long).select("word", "chain").unionByName(whole.where(~is_long).select("word", "chain").join(whole.where(is_long).select(F.col("source").alias("word")).distinct(), "word", "left_semi")).distinct()
    weighed = checkpointed(weighed)
    asked = checkpointed(weighed.select("word").unionByName(by_run.select("word")).unionByName(short.select("word")).unionByName(whole.where(is_long).select("word")).distinct())
    near = texts.where("octet_length(text) > char_length(text) or instr(text, '?') > 0").select(F.unhex(F.md5("text")).alias("id"), "text").mapInArrow(_beside, "id binary, word string, odd long")
    # Moved to its text once; what follows is counted text by text.
    near = checkpointed(near.join(small_side(asked), "word").repartition("id").distinct())

    held = near.join(small_side(weighed), "word").withColumn("long", is_long.cast("int"))
    beside = held.withColumn("others", F.sum("long").over(Window.partitionBy("id", "chain")) - F.col("long"))
    per = checkpointed(beside.groupBy("word", "chain").agg(F.avg(F.col("others") / F.greatest(F.col("odd") - 1, F.lit(1))).alias("share"), F.avg((F.col("others") > 0).cast("int")).alias("half")))
    against = per.select(F.col("word").alias("source"), F.col("chain").alias("back"), F.col("share").alias("against"))
    won = whole.where(is_long).join(per, ["word", "chain"]).join(against, ["source", "back"], "left").where("half >= 0.5 and share > coalesce(against, 0)")
    settled = whole.join(clear.where("kind = 'same' and not is_run").select("word", "source"), ["word", "source"], "left_semi")
    won = checkpointed(won.select("word", "source", "chain").unionByName(settled.where(is_long).select("word", "source", "chain")).distinct())

    # A pair that was settled, or won, leaves no open question for its source.
    clean = won.select(F.col("source").alias("word")).distinct()
    late = short.unionByName(by_run.mapInPandas(_put_in, "word string, source string, chain string")).where("source is not null")
    late = late.join(won.select("word").distinct(), "word", "left_anti").join(clean, "word", "left_anti")
    seeds = near.join(won.select("word", "chain").distinct(), "word").select("id", "chain").distinct()
    late = checkpointed(late)
    # Only texts with a seed can count for a word, and how many hold the word does not depend on the chain.
    hold = near.join(small_side(late.select("word").distinct().transform(checkpointed)), "word")
    seeded = hold.join(seeds, "id").groupBy("word", "chain").agg(F.count(F.lit(1)).alias("seeded"))
    late = late.join(seeded, ["word", "chain"]).join(hold.groupBy("word").agg(F.count(F.lit(1)).alias("held")), "word").withColumn("half", F.col("seeded") / F.col("held")).where("half >= 0.5")
    first = Window.partitionBy("word").orderBy(F.desc("half"), "chain", "source")
    late = late.withColumn("no", F.row_number().over(first)).where("no = 1").select("word", "source", "chain")
    return won, checkpointed(late)


def garbled_words(docs: DataFrame) -> DataFrame:
    """The garbled words of a corpus: `word` (normalised), `source` (the clean word, null if it can't be told), `chain`, `weak`.

    `docs` has a column `text` without nulls. A word is `weak` if it is a single
    character and only numbers of texts speak against it; it then needs another
    garbled word beside it.
    """
    texts = docs.select("text").distinct()
    counted = texts.mapInArrow(_count, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    counted = checkpointed(counted)
    odd = counted.where("docs > 0")
    plain = counted.where("docs = 0").select("word")

    runs = odd.select("word", "docs", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit("([^\\x00-\\x7f]+)"), F.lit(1)))).alias("run"))
    units = odd.select("word", "docs", F.lit(False).alias("is_run")).unionByName(runs.groupBy("run").agg(F.sum("docs").alias("docs")).select(F.col("run").alias("word"), "docs", F.lit(True).alias("is_run")))
    # Making forms is the longest step; a number of its own keeps the few words from being put into one task.
    units = checkpointed(units.repartition(max(FORM_TASKS, 2 * odd.count() // FORM_WORDS), "word"))
    words = docs.sparkSession.sparkContext.broadcast(_filter(units))
    made = units.mapInArrow(_forms(words), "form string, source string, source_docs long, form_is_run boolean, chain string, kind string, chains array<string>")
    hits = made.join(units, (F.col("form") == F.col("word")) & (F.col("form_is_run") == F.col("is_run"))).select("word", "docs", "is_run", "source", "source_docs", "chain", "kind", "chains")
    hits = checkpointed(hits)
    clear = hits.where(f"kind <> 'same' or (not is_run and source_docs >= {CLEAN_RATIO} * docs)")
    won, late = _by_neighbours(docs.select("text"), hits, clear, runs)
    hits = checkpointed(clear.drop("chains").unionByName(hits.drop("chains").where("kind = 'same' and not is_run").join(won.select("word", "source").distinct(), ["word", "source"], "left_semi")).distinct())

    # Of the sources of a word, those that are not garbled themselves come first, then the surest kind, then the one in most documents.
    bad = hits.select(F.col("word").alias("source"), "is_run").distinct().withColumn("impure", F.lit(True))
    ranked = hits.join(bad, ["source", "is_run"], "left").withColumns({"impure": F.coalesce("impure", F.lit(False)), "order": F.when(F.col("kind") == "wide", 0).when(F.col("kind") == "same", 1).otherwise(2)})
    best = ranked.groupBy("word", "is_run").agg(F.min(F.struct("impure", "order", (-F.col("source_docs")).alias("rank"), "source", "chain", "kind")).alias("b"), F.count_distinct(F.when((F.col("kind") == "lossy") & ~F.col("impure"), F.col("source"))).alias("lossy_sources"))
    single = (F.col("b.kind") == "lossy") & (F.col("lossy_sources") > 1)
    best = checkpointed(best.select("word", "is_run", F.when(~single & ~F.col("b.impure"), F.col("b.source")).alias("source"), "b.chain", "b.kind"))

    by_word = best.where("not is_run").select("word", "source", "chain", ((F.char_length("word") == 1) & (F.col("kind") == "same")).alias("weak"))
    in_runs = runs.join(best.where("is_run").select(F.col("word").alias("run"), "source", "chain"), "run").groupBy("word").agg(F.collect_list("run").alias("runs"), F.collect_list(F.coalesce("source", F.lit(""))).alias("filled"), F.min("chain").alias("chain"))
    in_runs = in_runs.select("word", "runs", F.transform("filled", lambda s: F.when(s != "", s)).alias("sources"), "chain")
    by_run = in_runs.mapInPandas(_put_in, "word string, source string, chain string").withColumn("weak", F.lit(False))
    by_text = late.withColumn("weak", F.char_length("word") == 1)
    lost = odd.where(F.col("word").contains(REPLACED)).select("word", F.lit(None).cast("string").alias("source"), F.lit("lost").alias("chain"), F.lit(False).alias("weak"))
    back = odd.where(F.col("word").rlike(ASCII_PAIR.pattern)).select("word").mapInPandas(_turned_back, "word string, repaired string, inner string")
    back = back.join(plain.withColumnRenamed("word", "inner").withColumn("known", F.lit(1)), "inner", "left").groupBy("word", "repaired").agg(F.count("inner").alias("n"), F.count("known").alias("known"))
    back = back.where("2 * known >= n").select("word", F.col("repaired").alias("source"), F.lit("ascii>utf-16").alias("chain"), F.lit(False).alias("weak"))

    every = None
    for order, part in enumerate((back, by_word, by_run, by_text, lost)):
        part = part.withColumn("order", F.lit(order))
        every = part if every is None else every.unionByName(part)
    first = Window.partitionBy("word").orderBy(F.col("source").isNull(), "order")
    return every.withColumn("weak", F.min("weak").over(Window.partitionBy("word"))).withColumn("no", F.row_number().over(first)).where("no = 1").select("word", "source", "chain", "weak")


def _texts(df: DataFrame, id: str, text: str) -> DataFrame:
    named = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return named.where("octet_length(text) > char_length(text) or instr(text, '?') > 0")


def _found(texts: DataFrame, garbled: DataFrame) -> DataFrame:
    """id, word, source of the garbled words of affected documents."""
    kind = texts.schema["id"].dataType.simpleString()
    mentions = texts.mapInArrow(_mention, f"id {kind}, word string")
    return mentions.join(small_side(garbled), "word")


def _affected(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.min("weak").alias("weak"), F.count(F.lit(1)).alias("n")).where("not weak or n > 1").select("id")


def find_garbled(df: DataFrame, id: str, text: str) -> DataFrame:
    """The ids, each once, of the records whose text holds a sequence that comes from a wrong decoding.

    Null, empty and plain ASCII texts are none. What counts as garbled depends
    on the corpus: words are compared with the other words in it. Texts of any
    length are read whole. Other columns are ignored.
    """
    counted = df.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    garbled = checkpointed(garbled_words(counted))
    return _affected(_found(_texts(df, id, text), garbled)).withColumnRenamed("id", id)


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, done, left = [], [], []
        for text, words, sources in zip(batch["text"], batch["words"], batch["sources"], strict=True):
            known = {w: s or None for w, s in zip(words, sources, strict=True)}
            out, n, m, at = [], 0, 0, 0
            for gap in [*WORD_BREAK.finditer(text), None]:
                token = text[at : gap.start() if gap else len(text)]
                key = normal(token)
                if key in known:
                    clean = with_digits(known[key], token) if known[key] is not None else None
                    if clean is None and known[key] is not None and known[key].isascii():
                        clean = _unspanned(token)
                    n, m = n + (clean is not None), m + (clean is None)
                    token = clean if clean is not None else token
                out.append(token)
                if gap:
                    out.append(gap.group())
                    at = gap.end()
            texts.append("".join(out))
            done.append(n)
            left.append(m)
        yield pd.DataFrame({"id": batch["id"], "restored": texts, "n_restored": done, "n_left": left})


def _unspanned(token: str) -> str | None:
    """A word with its UTF-16 spans turned back; digits may stand in them."""
    out = ASCII_PAIR.sub(lambda m: utf16_text(m.group()) or m.group(), token)
    return out if out != token else None


def repair_garbled(df: DataFrame, id: str, text: str) -> DataFrame:
    """The affected records with their original text: `id`, `restored`, `n_restored`, `n_left` (garbled words that stay as they are).

    Everything but garbled words is kept byte for byte. Ids should be unique;
    records that share one are repaired with the words of both.
    """
    counted = df.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    garbled = checkpointed(garbled_words(counted))
    texts = _texts(df, id, text)
    found = _found(texts, garbled)
    affected = found.groupBy("id").agg(F.min("weak").alias("weak"), F.collect_list("word").alias("words"), F.collect_list(F.coalesce("source", F.lit(""))).alias("sources"))
    affected = affected.where("not weak or size(words) > 1").drop("weak").withColumnRenamed("id", "key")
    kind = texts.schema["id"].dataType.simpleString()
    joined = texts.join(affected, F.col("id").eqNullSafe(F.col("key"))).drop("key")
    return joined.mapInPandas(_repair, f"id {kind}, restored string, n_restored int, n_left int").withColumnRenamed("id", id)
