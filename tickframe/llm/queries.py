"""The registered queries of this package, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.bpe import digests, encode
from tickframe.llm.common import held_out, table
from tickframe.llm.dualtree import rank_documents
from tickframe.llm import kneser_ney
from tickframe.llm.langid import fit as fit_languages
from tickframe.llm.langid import identify
from tickframe.llm.mixing import mix_words
from tickframe.llm.neardup import near_duplicates
from tickframe.llm.packing import text_shards
from tickframe.llm.repetition import GRAM_LIMITS, LINE_CHAR_LIMIT, LINE_LIMIT, TOP_LIMITS, repetition
from tickframe.llm.rulefit import quality
from tickframe.llm.secrets import find_secrets
from tickframe.llm.secrets import fit as fit_secrets
from tickframe.llm.spelling import group_variants, text_words
from tickframe.llm.tiling import contaminated
from tickframe.llm.windows import budgeted_windows, conversation_digests
from tickframe.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Longer forms of registered queries: the whole job where a test fixes the smaller one.
LONGER: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str, sql: str | None = None, registry: dict[str, Callable[[SparkSession, str], DataFrame]] = QUERIES):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        registry[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def repetition_sql(source: str = "documents") -> str:
    """The measures and verdict of ``repetition`` for every row of a table."""
    lengths = [*TOP_LIMITS, *GRAM_LIMITS]
    windows = "\n".join(
        f"""windows_{n} as (select r, p, list_aggregate(words[p:p + {n - 1}], 'string_agg', ' ') as g
          from places where p + {n - 1} <= len(words)),
        twice_{n} as (select r, g, count(*) as n, min(p) as first from windows_{n} group by r, g having count(*) > 1),"""
        for n in lengths
    )
    tops = "\n".join(
        f"""top_{n} as (select r, max((n - 1) * length(replace(g, ' ', ''))) as chars from twice_{n} group by r),"""
        for n in TOP_LIMITS
    )
    insides = "\n".join(
        f"""inside_{n} as (select r, sum(length(words[q])) filter (later) as chars, count(*) as n from (
          select r, any_value(words) as words, q, bool_or(p > first) as later from (
            select w.r, t.words, w.p, w.first, unnest(range(w.p, w.p + {n})) as q
            from (select * from windows_{n} join twice_{n} using (r, g)) w join texts t on t.r = w.r)
          group by r, q) group by r),"""
        for n in GRAM_LIMITS
    )
    joins = " ".join([*(f"left join top_{n} on top_{n}.r = t.r" for n in TOP_LIMITS),
                      *(f"left join inside_{n} on inside_{n}.r = t.r" for n in GRAM_LIMITS)])
    limits = {f"top_chars_{n}": x for n, x in TOP_LIMITS.items()} | {f"dup_chars_{n}": x for n, x in GRAM_LIMITS.items()}
    shares = " ".join(f"or 100 * {name} > {limit} * word_chars" for name, limit in limits.items())
    sums = [f"coalesce({name.replace('top_chars', 'top').replace('dup_chars', 'inside')}.chars, 0) as {name}" for name in limits]
    return rf"""
    with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as text,
          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from {source}),
        places as (select r, words, unnest(range(1, len(words) + 1)) as p from texts),
        lines as (select r, line, count(*) as n from (select r, unnest(string_split(text, chr(10))) as line from texts)
          where regexp_matches(line, '[^\x20\x09-\x0D]') group by r, line),
        line_sums as (select r, sum(n) as n_lines, sum(n - 1) as n_dup_lines, sum((n - 1) * length(line)) as dup_line_chars
          from lines group by r),
        {windows}
        {tops}
        {insides}
        measured as (select t.doc_id, len(words) as n_words,
          length(array_to_string(words, '')) as word_chars,
          len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(l.n_dup_lines, 0) as n_dup_lines,
          coalesce(inside_8.n, 0) as n_repeat_words, coalesce(l.n_lines, 0) as n_lines,
          coalesce(l.dup_line_chars, 0) as dup_line_chars,
          {", ".join(sums)}
          from texts t left join line_sums l on l.r = t.r {joins}),
        judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from measured)
    select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
      cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
      cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
      not (base_failed or 100 * n_dup_lines > {LINE_LIMIT} * n_lines
        or 100 * dup_line_chars > {LINE_CHAR_LIMIT} * word_chars {shares}) as kept,
      cast(n_lines as bigint) as n_lines, cast(dup_line_chars as bigint) as dup_line_chars,
      {", ".join(f"cast({name} as bigint) as {name}" for name in limits)}
    from judged"""


@query("op3_repetition", repetition_sql())
def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition coverage and verdict of every document."""
    return repetition(table(spark, sf_dir, "documents"))


@query("op10_dart_minhash")
def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_string_tiling")
def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a benchmark item or more."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The query adds a conversation whose texts look like the template.
TRICKY = "\\### Assistant: </turn> ok"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return given.union(spark.range(2).select(F.lit(-7).cast("long"), "id", role, F.lit(TRICKY)))


@query("op6_budgeted_windows")
def op6_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation read back from its windows."""
    return conversation_digests(budgeted_windows(conversations(spark, sf_dir)))


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the encoded and decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, TOKENIZER, decoded_col="decoded").select("doc_id", *digests())


@query("op5_best_fit")
def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    law = {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    return text_shards(table(spark, sf_dir, "documents")).withColumns(law)


@query("op7_rule_ensemble")
def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from labels outside the fifth fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality(docs, labels.where(~held_out(5, 0)))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


@query("op9_bigru_langid")
def op9_bigru_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_languages(docs.where(~held_out(4, 2))))
    return found.withColumn("held_out", held_out(4, 2)).select("doc_id", "held_out", "lang_pred", "score", "letters", "agreement")


def scored_by_model(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    """Log probability of every document under a model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(~held_out(7, 2)), order=order)
    found = kneser_ney.score(table(spark, sf_dir, "documents"), model).withColumn("held_out", held_out(7, 2))
    first = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return found.select(*first, "perplexity")


@query("op2_kneser_ney_trigrams", registry=LONGER)
def op2_kneser_ney_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a trigram model of six sevenths of them."""
    return scored_by_model(spark, sf_dir, 3)


@query("op2_kneser_ney")
def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a bigram model of six sevenths of them."""
    return scored_by_model(spark, sf_dir, 2)


@query("op1_secret_forest")
def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in the documents; a document's source stands for its path."""
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, *fit_secrets(docs))


@query("op13_pivotal_mix")
def op13_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    mixed = mix_words(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def spelling_sql(source: str = "documents") -> str:
    """Near words by equal remains after deleting one place, CRC-32 as a fold over bytes, roots by recursion."""
    return r"""
    with recursive crc_table as (select list(list_reduce(list_prepend(b, range(8)),
            lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t
          from (select unnest(range(256)) as b)),
        runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) as run from SOURCE),
        counted as (select doc_id, run, count(*) as times from runs group by all),
        coded as (select run, times, hex(encode(concat(coalesce(cast(doc_id as varchar), ''), ':', run))) as code, t from counted, crc_table),
        summed as (select run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(code) // 2),
            lambda i: cast('0x' || code[2 * i + 1:2 * i + 2] as bigint))),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from coded),
        slipped as (select times, case when h % 31 = 0
            then concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) else run end as word from summed),
        words as (select word, cast(sum(times) as bigint) as n from slipped where length(word) >= 7
            group by word having sum(times) >= 2),
        places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
        remains as (select distinct word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) as rest from places),
        pairs as (select a.word, b.word as near, b.n as near_n from remains a join remains b using (i, rest) where a.word <> b.word
          union select a.word, b.word, b.n from remains a join words b on a.rest = b.word
          union select b.word, a.word, a.n from remains a join words b on a.rest = b.word),
        best as (select word, count(*) as n_near, max(near_n) as near_n from pairs group by word),
        first as (select word, min(near) as near from pairs join best using (word, near_n) group by word),
        forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * w.n then near end as form,
            case when near_n >= 10 * w.n then near_n end as form_n
          from words w left join best using (word) left join first using (word)),
        steps as (select word, word as goal, 0 as k from forms
          union all select s.word, f.form, k + 1 from steps s join forms f on s.goal = f.word where f.form is not null),
        roots as (select word, arg_max(goal, k) as root from steps group by word)
    select word, form, root, n, n_near, form_n from forms join roots using (word)""".replace("SOURCE", source)


@query("op11_spelling_variants", spelling_sql())
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent form and root of every word of the documents, some of them with a slip made by checksum."""
    return group_variants(text_words(table(spark, sf_dir, "documents")))


def ranked_search_sql(documents: str = "documents", benchmark: str = "benchmark", k: int = 50) -> str:
    """Every item against every document, by joins over terms."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    with docs as (select row_number() over () as d, doc_id, regexp_extract_all({lower}, '{term}') as terms from {documents}),
        filled as (select d, doc_id, terms, len(terms) as n from docs where len(terms) > 0),
        total as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from filled),
        counts as (select d, term, count(*) as tf from (select d, unnest(terms) as term from filled) group by all),
        weights as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w
          from counts, total group by term),
        lengths as (select d, doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) as m from filled, total),
        items as (select row_number() over () as i, item_id, list_distinct(regexp_extract_all({lower}, '{term}')) as terms
          from {benchmark}),
        asked as (select i, item_id, unnest(terms) as term from items),
        scored as (select i, item_id, d, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
          from asked join weights using (term) join counts using (term) join lengths using (d) group by all)
    select item_id, cast(row_number() over (partition by i order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
    from scored join lengths using (d) where score > 0 qualify rank <= {k}"""


@query("op12_dual_tree", ranked_search_sql())
def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
