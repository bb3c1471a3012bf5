"""Inputs of the registered queries, derived from the given tables: one Spark and one SQL form each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tongueloom.functions.hashing import hash32, hash_word32
from tongueloom.functions.text import words
from tongueloom.operators import clean
from tongueloom.session import spread

SEED = 1234
ENTITY_TYPES = ["PER", "LOC", "ORG", "DATE"]
DOC_SHIFT = 1 << 24  # line numbers per document in the CoNLL view
REMEMBERED = 200_000  # words whose tags a task keeps
LINES = 200_000  # token lines that a task hands on at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("row_id"), F.col("text").alias("input"))
    return spread(docs, "row_id")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.to_sentences(corpus(spark, sf_dir))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("lang", "row_id", F.col("input").alias("news_title"), F.upper("lang").alias("label"))


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hash32(F.col("row_id")) % 11
    return topics(spark, sf_dir).select(
        "lang", "row_id",
        F.when(h == 0, F.lit(None)).when(h == 1, F.lit("  ")).when(h == 4, F.lit("NA")).when(h == 5, F.lit("null")).otherwise(F.col("news_title")).alias("news_title"),
        F.when(h == 2, F.lit(None)).otherwise(F.col("label")).alias("label"), F.when(h != 3, F.lit("1 Oṣù")).alias("date"),
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("label"))
    return corpus(spark, sf_dir).join(marks, "row_id")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("scores"), F.col("label").cast("bigint").alias("gold"))


def _tag_array(w: Column) -> Column:
    """Invented tags: the word's hash chooses the type; ``I-`` continues a type."""
    names = F.array(*[F.lit(t) for t in ENTITY_TYPES])
    kinds = F.transform(w, lambda x: F.get(names, (hash32(x) % 10).cast("int")))

    def with_prefix(ks: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(ks, F.lit(1), F.size(ks) - 1))
        return F.zip_with(ks, before, lambda k, b: F.when(k.isNull(), F.lit("O")).when(
            b == k, F.concat(F.lit("I-"), k)).otherwise(F.concat(F.lit("B-"), k)))

    return F.transform(F.array(kinds), with_prefix)[0]  # bound once: the hashes are not computed twice


def _tag_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``_tag_array`` for whole batches: the first ``REMEMBERED`` words of a task are hashed once."""
    known: dict[str, int] = {}
    names = pa.array(["O", *[f"B-{k}" for k in ENTITY_TYPES], *[f"I-{k}" for k in ENTITY_TYPES]])
    n_kinds = len(ENTITY_TYPES)

    def code_of(word: str) -> int:
        got = known.get(word)
        if got is None:
            at = hash_word32(word) % 10
            got = at + 1 if at < n_kinds else 0
            if len(known) < REMEMBERED:
                known[word] = got
        return got

    for words_ in batches:
        coded = words_.flatten().dictionary_encode()
        codes = np.array([code_of(w) for w in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words_).to_numpy(zero_copy_only=False))])
        goes_on = np.zeros(len(codes), dtype=bool)
        goes_on[1:] = (codes[1:] == codes[:-1]) & (codes[1:] > 0)
        goes_on[ends[:-1][ends[:-1] < len(codes)]] = False
        yield pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), names.take(pa.array(codes + n_kinds * goes_on)))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_of(corpus(spark, sf_dir))


def tagged_of(records: DataFrame) -> DataFrame:
    """(lang,row_id,line_no,guid,words,labels,pred) for lines of more than five words."""
    lines_ = clean.min_words(clean.to_sentences(records))
    drop = lambda t, i: F.when(
        hash32("p", F.col("row_id"), F.col("line_no"), i) % 10 == 0, F.lit("O")).otherwise(t)
    return (
        lines_.select("lang", "row_id", "line_no", F.concat_ws("-", "lang", "row_id", "line_no").alias("guid"),
                      words(F.col("line")).alias("words"))
        .withColumn("labels", F.arrow_udf(_tag_lists, "array<string>")("words"))
        .withColumn("pred", F.transform("labels", drop))
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(corpus(spark, sf_dir))


def tokens_of(records: DataFrame) -> DataFrame:
    """(lang,row_id,line_no,pos,word,tag)."""
    zipped = F.arrays_zip(F.col("words").alias("word"), F.col("labels").alias("tag"))
    return tagged_of(records).select("lang", "row_id", "line_no", F.posexplode(zipped).alias("pos", "z")).select(
        "lang", "row_id", "line_no", F.col("pos").cast("bigint"), "z.word", "z.tag")


def conll_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conll_lines_of(corpus(spark, sf_dir))


class _Forms(dict):
    """Of each word its kind, and its token line where it opens an entity and where it goes on with one; the first ``REMEMBERED`` words are kept."""

    def __missing__(self, word: str) -> tuple[int, str, str]:
        at = hash_word32(word) % 10
        got = (at, f"{word} B-{ENTITY_TYPES[at]}", f"{word} I-{ENTITY_TYPES[at]}") if at < len(ENTITY_TYPES) else (-1, f"{word} O", f"{word} O")
        if len(self) < REMEMBERED:
            self[word] = got
        return got


def _token_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(file, line_no, line)`` of rows ``(lang, row_id, input)``, handed on when there are more than ``LINES`` of them."""
    known = _Forms()

    def body(row: int | None, text: str) -> list[str]:
        out = ["-DOCSTART- O", ""] if row is not None and row % 100 == 0 else []
        copy = md5(b"n|" if row is None else b"n|%d|" % row, usedforsecurity=False).copy  # a null is left out of a hash's parts
        sentences_ = [(line, split) for line in map(str.strip, text.strip().splitlines()) if len(split := line.split()) > 5]
        bare = set()
        for word in {word for _, split in sentences_ for word in split}:
            own = copy()
            own.update(word.encode())
            if int.from_bytes(own.digest()[:4], "big") % 50 == 0:
                bare.add(word)
        for line, split in sentences_:
            before = -1
            for word in split:
                kind, opens, goes_on = known[word]
                out.append(word if word in bare else goes_on if kind == before else opens)
                before = kind
            out.extend(("", "") if hash_word32(f"b|{line}") % 97 == 0 else ("",))
        return out

    for batch in batches:
        rows, texts, done = batch.column("row_id").to_pylist(), batch.column("input"), 0
        lines_: list[str] = []
        sizes: list[int] = []

        def flat() -> pa.RecordBatch:
            at = np.repeat(np.arange(done, done + len(sizes)), sizes)
            place = np.arange(len(lines_)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = pc.multiply_checked(batch.column("row_id").take(pa.array(at)), DOC_SHIFT)
            return pa.RecordBatch.from_arrays(
                [batch.column("lang").take(pa.array(at)), pc.add_checked(first, pa.array(place)), pa.array(lines_, type=pa.string())], names=["file", "line_no", "line"])

        for row, text in zip(rows, texts):
            got = body(row, text.as_py()) if text.is_valid else []
            lines_ += got
            sizes.append(len(got))
            if len(lines_) > LINES:
                yield flat()
                done, lines_, sizes = done + len(sizes), [], []
        if lines_:
            yield flat()


def conll_lines_of(records: DataFrame) -> DataFrame:
    """(file,line_no,line): tagged sentences as token lines, one file per language.

    Some tokens carry no tag, some sentences end in two empty lines, some documents open with a mark.
    """
    return records.select("lang", F.col("row_id").cast("long"), "input").mapInArrow(_token_lines, "file string, line_no long, line string")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("l"), (F.col("event_id") % 4).cast("string")).alias("lang"), F.col("event_type").alias("task"),
        (F.col("user_id") % 5 + 1).alias("seed"), F.dayofmonth("ts").cast("bigint").alias("step"), F.col("value"))


# ---- the same inputs in SQL -------------------------------------------------

def h32(expr: str, word: int = 0) -> str:
    return f"cast('0x' || substr(md5({expr}), {1 + 8 * word}, 8) as bigint)"


def h60(expr: str) -> str:
    return f"cast('0x' || substr(md5({expr}), 1, 15) as bigint)"


def wc(expr: str) -> str:
    return f"(case when trim({expr}) = '' then 0 else len(regexp_split_to_array(trim({expr}), ' +')) end)"


def ws(expr: str) -> str:
    return f"regexp_split_to_array(trim({expr}), ' +')"


BLANK = "' ' || chr(10) || chr(13) || chr(9)"
KIND = "['PER','LOC','ORG','DATE']"

SQL = {
    "corpus": "select lang, doc_id as row_id, text as input from documents",
    "sentences": f"""
        select lang, row_id, cast(i - 1 as bigint) as line_no, trim(l, {BLANK}) as line from (
          select lang, row_id, unnest(a) as l, generate_subscripts(a, 1) as i from (
            select lang, row_id, string_split(trim(input, {BLANK}), chr(10)) as a from corpus))""",
    "topics": "select lang, row_id, input as news_title, upper(lang) as label from corpus",
    "missing": f"""
        select lang, row_id,
          case {h32('cast(row_id as varchar)')} % 11 when 0 then null when 1 then '  ' when 4 then 'NA' when 5 then 'null' else news_title end as news_title,
          case {h32('cast(row_id as varchar)')} % 11 when 2 then null else label end as label,
          case {h32('cast(row_id as varchar)')} % 11 when 3 then null else '1 Oṣù' end as date
        from topics""",
    "lexicon": """
        select lang, word, tag from (
          select lang, word, tag, row_number() over (partition by lang, word order by count(*) desc, tag) as k
          from tokens join splits using (lang, row_id) where split = 'train' group by lang, word, tag) where k = 1""",
    "quality": """
        select c.lang, c.row_id, c.input, cast(l.quality as varchar) as label
        from corpus c join labels l on l.doc_id = c.row_id""",
    "scores": "select vec_id, embedding as scores, cast(label as bigint) as gold from embeddings",
    "long_lines": f"select * from sentences where {wc('line')} > 5",
    "raw_tokens": f"""
        select lang, row_id, line_no, line, cast(i - 1 as bigint) as pos, word, {KIND}[{h32('word')} % 10 + 1] as kind from (
          select lang, row_id, line_no, line, unnest(w) as word, generate_subscripts(w, 1) as i
          from (select *, {ws('line')} as w from long_lines))""",
    "tokens": f"""
        select lang, row_id, line_no, line, pos, word, tag,
          case when {h32("'p|' || row_id || '|' || line_no || '|' || pos")} % 10 = 0 then 'O' else tag end as pred
        from (select *, case when kind is null then 'O'
            when kind = lag(kind) over (partition by row_id, line_no order by pos) then 'I-' || kind
            else 'B-' || kind end as tag from raw_tokens)""",
    "conll_lines": f"""
        select lang as file, row_id * {DOC_SHIFT} + row_number() over (partition by row_id order by line_no, pos) - 1 as line_no, line
        from (
          select lang, row_id, line_no, pos,
            case when {h32("'n|' || row_id || '|' || word")} % 50 = 0 then word else word || ' ' || tag end as line from tokens
          union all select lang, row_id, line_no, 1000000000, '' from long_lines
          union all select lang, row_id, line_no, 1000000001, '' from long_lines where {h32("'b|' || line")} % 97 = 0
          union all select lang, row_id, -1, 0, '-DOCSTART- O' from corpus where row_id % 100 = 0
          union all select lang, row_id, -1, 1, '' from corpus where row_id % 100 = 0)""",
    "runs": """
        select 'l' || (event_id % 4) as lang, event_type as task, user_id % 5 + 1 as seed,
          cast(day(ts) as bigint) as step, value from events""",
    "shuffled": f"""
        select *, row_number() over (partition by lang order by digest, row_id) as pos, count(*) over (partition by lang) as total
        from (select *, md5('{SEED}|' || row_id) as digest from corpus)""",
    "splits": "select *, case when pos <= ceil(0.2::double * total) then 'eval' else 'train' end as split from shuffled",
    "split_lines": """
        select lang, row_id, s.line_no, s.line, p.digest, p.split from sentences s join splits p using (lang, row_id)""",
    "train_lines": f"select * from split_lines where split = 'train' and {wc('line')} > 5",
    "eval_lines": f"select * from split_lines where split = 'eval' and {wc('line')} > 5",
    "window_lines": f"select * from split_lines where split = 'eval' and {wc('line')} >= 5 and {wc('line')} < 256",
    "bigram_rows": f"""
        select lang, w[i] as prev, w[i + 1] as next from (
          select lang, w, unnest(range(1, len(w))) as i from (select lang, {ws('line')} as w from train_lines))""",
    "bigram_counts": "select lang, prev, next, count(*) as n from bigram_rows group by all",
    "top_next": """
        select lang, prev, next, n from (
          select *, row_number() over (partition by lang, prev order by n desc, next) as rk from bigram_counts) where rk = 1""",
    "numbered": """
        select *, row_number() over (partition by lang order by digest, row_id, line_no) as idx,
          count(*) over (partition by lang) as total from window_lines""",
    "draws": f"""
        select lang, draw, {h60(f"'{SEED}|draw|' || lang || '|' || draw")} % n + 1 as idx from (
          select lang, n, unnest(range(1, 1 + n)) as draw
          from (select lang, count(*) as n from window_lines group by lang))""",
    "sampled": "select n.lang, d.draw, n.row_id, n.line_no, n.line from numbered n join draws d using (lang, idx)",
    "prompts": """
        select lang, draw, row_id, line_no, line, k as n_tokens, array_to_string(w[1:len(w) - k], ' ') as prompt from (
          select *, cast(floor(len(w) * 0.15::double) + 1 as integer) as k from (
            select *, regexp_split_to_array(trim(line), ' +') as w from sampled))""",
    "completed": """
        select lang, draw, prompt, n_tokens, arg_max(text, step) as sentence from walk group by all""",
    "word_counts": f"""
        select word, count(*) as n from (select unnest({ws('line')}) as word from sentences where line <> '')
        where word <> '' group by word""",
    "char_counts": """
        select ch, sum(n)::bigint as n from (select unnest(string_split('▁' || word, '')) as ch, n from word_counts) group by ch""",
    "alphabet": """
        select ch, n, rk from (
          select ch, n, row_number() over (order by n desc, ch) as rk, sum(n) over (order by n desc, ch) - n as before, sum(n) over () as everything
          from char_counts) where before < 0.9995::double * everything""",
}
RECURSIVE = {
    "walk": """
        select lang, draw, prompt, n_tokens, prompt as text, 0 as step, regexp_split_to_array(prompt, ' ')[-1] as cur from prompts
        union all
        select w.lang, w.draw, w.prompt, w.n_tokens, w.text || ' ' || t.next, w.step + 1, t.next
        from walk w join top_next t on t.lang = w.lang and t.prev = w.cur where w.step < w.n_tokens""",
}


# referenced more than once, or costly to expand in place
MATERIALIZED = ("top_next", "prompts", "sentences", "corpus_", "splits", "tokens", "raw_tokens", "long_lines", "word", "pairs", "encoded", "alphabet", "lexicon", "held", "first_pieces")


def _needs(body: str, defs: dict[str, str]) -> list[str]:
    return [n for n in defs if re.search(rf"\b{n}\b", body)]


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind a WITH list of just the views it uses, in dependency order."""
    defs = {**SQL, **RECURSIVE, **(extra or {})}
    order: list[str] = []

    def visit(text: str, skip: str = "") -> None:
        for name in _needs(text, defs):
            if name != skip and name not in order:
                visit(defs[name], name)
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    once = lambda n: " MATERIALIZED" if n.startswith(MATERIALIZED) else ""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS{once(n)} ({defs[n]})" for n in order) + "\n" + body
