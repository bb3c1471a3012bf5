"""The registered queries in SQL, over the same tables."""

from __future__ import annotations

import re

from tongueloom.plans.catalog import N_MERGES, NER_MAX_LEN, QUALITY_LABELS, SEEDS, TASKS, TOPIC_LABELS, VOCAB_SIZE
from tongueloom.plans.views import BLANK, DOC_SHIFT, RECURSIVE, SEED, SQL, h32, h60, wc, with_views, ws

TAG_LIST = "['O','B-DATE','I-DATE','B-PER','I-PER','B-ORG','I-ORG','B-LOC','I-LOC']"


def _bpe() -> dict[str, str]:
    """One pair of CTEs per merge: the winning pair, then the words with it merged."""
    out = {"words0": "select word, n, ' ' || array_to_string(string_split('▁' || word, ''), '  ') || ' ' as sym from word_counts"}
    for i in range(1, N_MERGES + 1):
        out[f"pairs{i}"] = f"""
            select a, b, n from (select s[k] as a, s[k + 1] as b, sum(n)::bigint as n from (
              select s, n, unnest(range(1, len(s))) as k from (select string_split(trim(sym), '  ') as s, n from words{i - 1}))
            group by 1, 2) order by n desc, a, b limit 1"""
        out[f"words{i}"] = f"""
            select word, words{i - 1}.n as n, replace(sym, ' ' || a || '  ' || b || ' ', ' ' || a || b || ' ') as sym from words{i - 1}, pairs{i}"""
    made = " union all ".join(f"select {i} as rk, a as left, b as right from pairs{i}".replace(" left", ' "left"').replace(" right", ' "right"')
                              for i in range(1, N_MERGES + 1))
    out["merges"] = made
    out["vocab"] = f"""
        select '<s>' as piece, 0::bigint as id union all select '<pad>', 1 union all select '</s>', 2 union all select '<unk>', 3
        union all select "left" || "right", rk + 3 from merges
        union all select ch, rk + {N_MERGES + 3} from alphabet
        union all select '<mask>', count(*) + {N_MERGES + 4} from alphabet"""
    out["word_pieces"] = f"select word, string_split(trim(sym), '  ') as p from words{N_MERGES}"
    out["word_ids"] = """
        select word, list(coalesce(v.id, 3) order by k) as ids from (
          select word, unnest(p) as piece, generate_subscripts(p, 1) as k from word_pieces) left join vocab v using (piece)
        group by word"""
    out["encoded"] = f"""
        select lang, row_id, line_no, k as chunk_no, [0::bigint] || whole[254 * k + 1:254 * k + 254] || [2::bigint] as ids from (
          select *, unnest(range(0, greatest(1, (len(whole) + 253) // 254))) as k from (
            select lang, row_id, line_no, flatten(list(ids order by pos)) as whole from (
              select lang, row_id, line_no, unnest(w) as word, generate_subscripts(w, 1) as pos
              from (select *, {ws('line')} as w from long_lines)) join word_ids using (word)
            group by lang, row_id, line_no))"""
    return out


def _features(cls_at_end: bool, sep_extra: bool, pad_left: bool, cls_seg: int, pad_seg: int) -> str:
    seps = 2 if sep_extra else 1
    room = NER_MAX_LEN - 1 - seps
    tail = "[" + ",".join(["2::bigint"] * seps) + "]"
    ign = lambda n: "[" + ",".join(["-100::bigint"] * n) + "]"
    if cls_at_end:
        ids, tags = f"ids || {tail} || [0::bigint]", f"tags || {ign(seps + 1)}"
        seg = f"list_transform(range(len(ids) + {seps}), lambda x: 0) || [{cls_seg}]"
    else:
        ids, tags = f"[0::bigint] || ids || {tail}", f"{ign(1)} || tags || {ign(seps)}"
        seg = f"[{cls_seg}] || list_transform(range(len(ids) + {seps}), lambda x: 0)"

    def pad(expr: str, fill: int) -> str:
        gap = f"list_transform(range({NER_MAX_LEN} - n), lambda x: {fill})"
        return f"array_to_string({gap + ' || ' + expr if pad_left else expr + ' || ' + gap}, ',')"

    return f"""
        select guid, chunk_no, {pad('i', 1)} as input_ids, {pad('list_transform(range(n), lambda x: 1)', 0)} as input_mask,
          {pad('s', pad_seg)} as segment_ids, {pad('t', -100)} as label_ids
        from (select guid, chunk_no, {ids} as i, {tags} as t, {seg} as s, len(ids) + {1 + seps} as n from (
          select guid, start // ({room} - longest + 1) as chunk_no, flatten(list(ids order by pos, part)) as ids,
            flatten(list([case when part = 0 then y else -100 end] || list_transform(range(len(ids) - 1), lambda x: -100::bigint) order by pos, part)) as tags
          from (
            select *, sum(len(ids)) over (partition by guid order by pos, part) - len(ids) as start, max(len(ids)) over (partition by guid) as longest
            from (select guid, pos, part, y, whole[part * {room // 2} + 1:(part + 1) * {room // 2}] as ids from (
              select lang || '-' || row_id || '-' || line_no as guid, pos, cast(list_position({TAG_LIST}, tag) - 1 as bigint) as y,
                ids as whole, unnest(range(0, (len(ids) + {room // 2 - 1}) // {room // 2})) as part
              from tokens join word_ids using (word))))
          group by all))"""


def _bayes(train: str, test: str) -> dict[str, str]:
    """Naive Bayes over the rows of ``quality_split`` that meet either condition."""
    return {
        "quality_split": f"""
            select *, case when pos <= ceil(0.2::double * total) then 'eval' else 'train' end as split from (
              select *, row_number() over (partition by lang order by md5('{SEED}|' || row_id), row_id) as pos,
                count(*) over (partition by lang) as total from quality)""",
        "nb_train": f"select label, unnest({_all_words('input')}) as word from quality_split where {train}",
        "nb_counts": "select label, word, count(*) as c from nb_train where word <> '' group by all",
        "nb_words": "select distinct word from nb_counts",
        "nb_labels": f"""
            select l.label, coalesce(t.total, 0) + (select count(*) from nb_words) as denominator,
              (select count(*) from quality_split where {train} and label = l.label) / (select count(*)::double from quality_split where {train}) as prior
            from (select unnest({QUALITY_LABELS}) as label) l
            left join (select label, sum(c) as total from nb_counts group by label) t using (label)""",
        "nb_test": f"""
            select row_id, word, count(*) as m from (
              select row_id, unnest({_all_words('input')}) as word from quality_split where {test}) where word <> '' group by all""",
        "nb_scores": f"""
            select q.row_id, l.label, round(ln(l.prior) + coalesce(s.s, 0), 6) as score
            from quality_split q cross join nb_labels l left join (
              select t.row_id, l.label, sum(t.m * (ln(coalesce(c.c, 0) + 1) - ln(l.denominator))) as s
              from nb_test t join nb_words w using (word) cross join nb_labels l
              left join nb_counts c on c.word = t.word and c.label = l.label group by all) s on s.row_id = q.row_id and s.label = l.label
            where {test}""",
        "nb_best": """
            select row_id, label as prediction, score from (
              select *, row_number() over (partition by row_id order by score desc, label) as k from nb_scores) where k = 1""",
    }


def _all_words(expr: str) -> str:
    return f"regexp_split_to_array(trim({expr}, {BLANK}), '\\s+')"


def _macro(source: str) -> str:
    return f"""
        with pairs as ({source}), classes as (select gold as c from pairs union select prediction from pairs),
        per_class as (
          select c, (select count(*) from pairs where gold = c and prediction = c)::double as tp,
            (select count(*) from pairs where gold = c)::double as g, (select count(*) from pairs where prediction = c)::double as p
          from classes),
        rates as (select *, case when p > 0 then tp / p else 0 end as pr, case when g > 0 then tp / g else 0 end as re from per_class)
        select round(sum(tp) / sum(g), 6) as accuracy, round(avg(pr), 6) as precision, round(avg(re), 6) as recall,
          round(avg(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end), 6) as f1
        from rates"""


def _conll() -> dict[str, str]:
    return {
        "conll_marked": """
            select *, sum(case when length(trim(line)) < 2 then 1 else 0 end) over (partition by file order by line_no) as gap
            from conll_lines""",
        "conll_tokens": """
            select file, line_no, gap, string_split(trim(line), ' ')[1] as word,
              case when contains(trim(line), ' ') then string_split(trim(line), ' ')[-1] else 'O' end as tag,
              row_number() over (partition by file, gap order by line_no) - 1 as pos
            from conll_marked where length(trim(line)) >= 2""",
    }


def _held() -> dict[str, str]:
    """Held-out tokens with the label that the first piece of their word carries most often in the other half (ties: the first label)."""
    return {**_bpe(),
        "first_pieces": """
            select t.lang, t.row_id, t.line_no, t.pos, t.tag, w.ids[1] as piece, s.split
            from tokens t join word_ids w using (word) join splits s on s.lang = t.lang and s.row_id = t.row_id""",
        "held_best": f"""
            select piece, tag from (
              select piece, tag, row_number() over (partition by piece order by count(*) desc, list_position({TAG_LIST}, tag)) as k
              from first_pieces where split = 'train' group by piece, tag) where k = 1""",
        "held_tokens": """
            select f.lang, f.row_id, f.line_no, f.pos, f.tag, coalesce(b.tag, 'O') as pred
            from first_pieces f left join held_best b using (piece) where f.split = 'eval'"""}


def _spans(name: str, col: str, tokens: str = "tokens") -> dict[str, str]:
    return {
        f"{name}_flags": f"""
            select lang, row_id, line_no, pos, {col} as t, case when {col} <> 'O' and (
                {col} like 'B-%' or before is null or before = 'O' or substr(before, 3) <> substr({col}, 3)) then 1 else 0 end as opens
            from (select *, lag({col}) over (partition by row_id, line_no order by pos) as before from {tokens})""",
        f"{name}_spans": f"""
            select lang, row_id, line_no, substr(min(t), 3) as type, min(pos) as "start", max(pos) as "end" from (
              select *, sum(opens) over (partition by row_id, line_no order by pos) as k from {name}_flags)
            where t <> 'O' group by lang, row_id, line_no, k""",
    }


def _probs(alpha: float) -> str:
    return f"""
        select lang, n, round(share / sum(share) over (), 6) as p from (
          select lang, n, power(n / (sum(n) over ())::double, {alpha}::double) as share
          from (select lang, count(*) as n from train_lines group by lang))"""


def _perplexity() -> dict[str, str]:
    def rows(source: str) -> str:
        return f"""
            select lang, w[i] as prev, w[i + 1] as next, count(*) as n from (
              select lang, w, unnest(range(1, len(w))) as i from (select lang, ['<s>'] || {ws('line')} || ['</s>'] as w from {source}))
            group by all"""
    return {
        "seen_pairs": rows("train_lines"), "asked_pairs": rows("eval_lines"),
        "seen_contexts": "select lang, prev, sum(n) as c from seen_pairs group by all",
        "type_counts": f"""
            select lang, count(distinct w) + 1 as v from (select lang, unnest({ws('line')}) as w from train_lines) group by lang""",
        "losses": """
            select a.lang, a.n, -ln((coalesce(s.n, 0) + 0.1::double) / (coalesce(c.c, 0) + 0.1::double * coalesce(t.v, 1))) as loss
            from asked_pairs a left join seen_pairs s using (lang, prev, next)
            left join seen_contexts c using (lang, prev) left join type_counts t using (lang)""",
    }


def _rounds(n: int) -> tuple[str, dict[str, str]]:
    """``n`` chained rounds: the views of one round, renamed per round, over the corpus of the round before."""
    chain = ("corpus sentences shuffled splits split_lines train_lines window_lines bigram_rows bigram_counts top_next "
             "numbered draws sampled prompts walk completed").split()
    ctes = {"corpus_1": "select lang, cast(row_id as varchar) as row_id, input, 0 as added from corpus"}
    rows = []
    for k in range(1, n + 1):
        one = {**SQL, **RECURSIVE}
        one["shuffled"] = one["shuffled"].replace(f"'{SEED}|'", f"'{SEED}|{k}|'")
        one["draws"] = one["draws"].replace(f"'{SEED}|draw|'", f"'{SEED}|{k}|draw|'")
        for name in chain[1:]:
            ctes[f"{name}_{k}"] = re.sub(rf"\b({'|'.join(chain)})\b", rf"\1_{k}", one[name])
        ctes[f"corpus_{k + 1}"] = f"""
            select lang, row_id, input, added from (
              select *, row_number() over (partition by lang, input order by added, try_cast(row_id as bigint), row_id) as r from (
                select * from corpus_{k}
                union all select lang, 'r{k}:' || md5(sentence), sentence, {k} from completed_{k})) where r = 1"""
        rows.append(f"""
            select {k}::bigint as round, lang, (select count(*) from corpus_{k} b where b.lang = a.lang) as n_before,
              count(*) filter (where added = {k}) as n_new, count(*) as n_after from corpus_{k + 1} a group by lang""")
    return " union all ".join(rows), ctes


RUN_SCORES = "select task, lang, step, round(avg(value), 6) as value from runs group by all"


def build() -> dict[str, str]:
    v = with_views
    bpe, conll = _bpe(), _conll()
    out = {
        "src_mono_corpus": v("select lang, row_number() over (partition by lang order by row_id) as row_id, input from corpus"),
        "src_lines": v("""
            select split as part, lang, count(*) as n_lines, 1::bigint as first_no, count(*) as last_no, count(*) as n_numbers,
              count(distinct line) as n_texts from split_lines group by split, lang"""),
        "src_labelled_tsv": v("select news_title, label from topics"),
        "src_conll": v("""
            select file, n as line_no, word, tag from conll_tokens join (
              select file, line_no, row_number() over (partition by file order by line_no) as n from conll_lines) using (file, line_no)""", conll),
        "src_label_list": v("""
            select label, row_number() over (order by label <> 'O', label) - 1 as label_id from (
              select tag as label from tokens where tag <> 'O' union select 'O')"""),
        "sink_splits": v("""
            select split as part, lang, line from split_lines
            union all select 'all_eval', 'all', line from split_lines where split = 'eval'"""),
        "sink_corpus_round": v("""
            select 0::bigint as round, lang, row_id, md5(input) as text_md5 from corpus
            union all select 1, lang, min(row_id), md5(input) from corpus group by lang, input"""),
        "sink_metrics": v("""
            select task || '-' || lang || '-' || seed as run_id,
              'best = ' || printf('%.6f', round(max(value), 6)) || chr(10) || 'mean = ' || printf('%.6f', round(avg(value), 6))
                || chr(10) || 'n = ' || printf('%.6f', count(*)::double) as text
            from runs group by task, lang, seed"""),
        "sink_guarded": v("select lang, row_id, 1 as refused from corpus"),
        "feature_cache": v("select lang, row_id, line_no, chunk_no, array_to_string(ids, ',') as input_ids from encoded", bpe),
        "normalise_lines": v("select * from sentences"),
        "filter_min_words": v("select * from long_lines"),
        "filter_len_window": v(f"select * from sentences where {wc('line')} >= 5 and {wc('line')} < 256"),
        "drop_missing": v("select * from missing where news_title is not null and label is not null and date is not null and trim(news_title) <> '' and news_title not in ('NA', 'null')"),
        "label_encode": v(f"select row_id, label, cast(list_position({TOPIC_LABELS}, lower(label)) - 1 as bigint) as label_id from topics"),
        "dedup_corpus": v("select lang, min(row_id) as row_id, input from corpus group by lang, input"),
        "concat_corpora": v("select row_number() over (order by lang, digest, row_id) as pos, lang, row_id from shuffled"),
        "shuffle_seeded": v("select lang, row_id, pos from shuffled"),
        "split_holdout": v("select lang, row_id, split from splits"),
        "holdout_union": v("select lang, row_id, md5(input) as text_md5 from splits where split = 'eval'"),
        "word_counts": v("select word, n from word_counts"),
        "char_coverage": v("select ch, n, rk from alphabet"),
        "bpe_pair_counts": v("""
            select s[k] as "left", s[k + 1] as "right", sum(n)::bigint as n from (
              select s, n, unnest(range(1, len(s))) as k from (select string_split(trim(sym), '  ') as s, n from words0))
            group by 1, 2""", bpe),
        "bpe_train": v('select rk::bigint as rk, "left", "right" from merges', bpe),
        "vocab_table": v(f"""
            select piece, id from (
              select '<s>' as piece, 0::bigint as id union all select '<pad>', 1 union all select '</s>', 2 union all select '<unk>', 3
              union all select "left" || "right", rk + 3 from merges where rk <= {VOCAB_SIZE} - 5 - (select count(*) from alphabet)
              union all select ch, {VOCAB_SIZE} - 2 - (select count(*) from alphabet) + rk from alphabet
              union all select '<mask>', {VOCAB_SIZE} - 1)""", bpe),
        "subword_encode": v("select word, array_to_string(p, ' ') as pieces from word_pieces", bpe),
        "encode_sequences": v("select lang, row_id, line_no, chunk_no, array_to_string(ids, ',') as input_ids from encoded", bpe),
        "pad_sequences": v("""
            select lang, row_id, line_no, chunk_no,
              array_to_string(ids || list_transform(range(m - len(ids)), lambda x: 1), ',') as input_ids,
              array_to_string(list_transform(range(len(ids)), lambda x: 1) || list_transform(range(m - len(ids)), lambda x: 0), ',') as attention_mask
            from (select *, max(len(ids)) over (partition by lang) as m from encoded)""", bpe),
        "labelled_features": v(f"""
            select row_id, cast(list_position({TOPIC_LABELS}, lower(label)) - 1 as bigint) as label_id, chunk_no,
              array_to_string(ids || list_transform(range(256 - len(ids)), lambda x: 1), ',') as input_ids,
              array_to_string(list_transform(range(len(ids)), lambda x: 1) || list_transform(range(256 - len(ids)), lambda x: 0), ',') as attention_mask
            from (
              select row_id, label, k as chunk_no, [0::bigint] || whole[254 * k + 1:254 * k + 254] || [2::bigint] as ids from (
                select *, unnest(range(0, greatest(1, (len(whole) + 253) // 254))) as k from (
                  select t.row_id, t.label, coalesce(whole, []) as whole from topics t left join (
                    select row_id, flatten(list(ids order by pos)) as whole from (
                      select row_id, unnest(w) as word, generate_subscripts(w, 1) as pos
                      from (select row_id, {_all_words('news_title')} as w from topics)) join word_ids using (word)
                    group by row_id) using (row_id))))""", bpe),
        "mlm_mask": v(f"""
            select lang, row_id, line_no, chunk_no, string_agg(case when not chosen then x
                when h2 < floor(0.8::double * 4294967296) then size when h2 < floor(0.9::double * 4294967296) then h3 % size else x end, ',' order by i) as input_ids,
              string_agg(case when chosen then x else -100 end, ',' order by i) as labels
            from (select *, x not in (0, 1, 2) and h1 < floor(0.15::double * 4294967296) as chosen from (
              select *, {h32('d', 0).replace('md5(d)', 'd')} as h1, {h32('d', 1).replace('md5(d)', 'd')} as h2, {h32('d', 2).replace('md5(d)', 'd')} as h3 from (
                select lang, row_id, line_no, chunk_no, i, x, size, md5('{SEED}|' || row_id || '|' || line_no || '|' || chunk_no || '|' || i) as d from (
                  select lang, row_id, line_no, chunk_no, unnest(ids) as x, generate_subscripts(ids, 1) - 1 as i, (select count(*) - 1 from vocab) as size
                  from encoded))))
            group by lang, row_id, line_no, chunk_no""", bpe),
        "ngram_fit": v("select lang, prev, next, n from bigram_counts"),
        "ngram_top": v("""
            select t.lang, t.prev, t.next, t.n, c.n_prev, c.n_next from top_next t join (
              select lang, prev, sum(n)::bigint as n_prev, count(*) as n_next from bigram_counts group by all) c using (lang, prev)"""),
        "heldout_perplexity": v("""
            select coalesce(lang, 'all') as lang, sum(n)::bigint as tokens, round(exp(sum(n * loss) / sum(n)), 3) as perplexity
            from losses group by grouping sets ((lang), ())""", _perplexity()),
        "build_prompts": v("select lang, draw, prompt, n_tokens::bigint as n_tokens from prompts"),
        "complete_prompts": v("select lang, draw, n_tokens::bigint as n_tokens, sentence from completed"),
        "predict_batches": v("""
            select lang, draw, prompt, case when regexp_matches(prompt, '[^\\x00-\\x7f]') then ''
              else prompt || ' ' || regexp_split_to_array(prompt, ' ')[-1] end as prediction,
              case when regexp_matches(prompt, '[^\\x00-\\x7f]') then 'ValueError: non-ASCII prompt' end as error from prompts"""),
        "augment_corpus": v("""
            select lang, md5(input) as text_md5, min(g) as is_generated from (
              select lang, input, 0 as g from corpus union all select lang, sentence, 1 from completed) group by lang, input"""),
        "active_rounds": v(*_rounds(3)),
        "active_rounds_all": v(*_rounds(3)),
        "lang_stats": v(f"""
            select coalesce(lang, 'total') as lang, coalesce(shard_id, -1) as shard_id, count(*) as n from shards group by cube (lang, shard_id)""",
            _shards()),
        "lang_probs": v(_probs(1.0)),
        "lang_probs_smoothed": v(_probs(0.3)),
        "worker_shards": v("select lang, row_id, line_no, shard_id from shards", _shards()),
        "lang_batches": v("""
            select o.batch_id, b.batch_pos, b.lang, b.row_id, b.line_no from batch_rows b join batch_order o using (lang, j)""", _batches()),
        "bootstrap_sample": v("select lang, draw, row_id, line_no, line from sampled"),
        "nb_classify": v("select row_id, prediction, round(score, 4) as score from nb_best", _bayes("split = 'train'", "split = 'eval'")),
        "linear_classify": v(f"""
            select cast(list_position({TOPIC_LABELS}, lower(label)) - 1 as bigint) as label_id, count(*) as n, true as accurate from (
              select *, row_number() over (partition by lang order by md5('{SEED}|' || row_id), row_id) as pos, count(*) over (partition by lang) as total
              from topics where trim(news_title, {BLANK}) <> '')
            where pos <= ceil(0.2::double * total) group by 1"""),
        "argmax_predictions": v("select vec_id, cast(list_position(scores, list_max(scores)) - 1 as bigint) as prediction from scores"),
        "classification_metrics": v(_macro("select gold, cast(list_position(scores, list_max(scores)) - 1 as bigint) as prediction from scores").replace(
            "with pairs", "select * from (with pairs", 1) + ")"),
        "cross_domain_eval": v(_macro("select q.label as gold, b.prediction from quality q join nb_best b using (row_id)").replace(
            "with pairs", "select * from (with pairs", 1) + ")", _bayes("lang = 'en'", "lang <> 'en'")),
        "conll_sentences": v("""
            select file, 'test-' || row_number() over (partition by file order by gap) as guid, words, labels from (
              select file, gap, string_agg(word, ' ' order by line_no) as words, string_agg(tag, ' ' order by line_no) as labels
              from conll_tokens group by file, gap)""", conll),
        "align_labels": v(_features(False, False, False, 0, 0), bpe),
        "align_labels_left": v(_features(True, True, True, 2, 4), bpe),
        "tag_tokens": v("""
            select t.row_id, t.line_no, t.pos, t.word, t.tag, coalesce(x.tag, 'O') as pred
            from tokens t join splits s on s.lang = t.lang and s.row_id = t.row_id left join lexicon x on x.lang = t.lang and x.word = t.word
            where s.split = 'eval'"""),
        "decode_tags": v("""
            select lang || '-' || row_id || '-' || line_no as guid, string_agg(tag, ' ' order by pos) as labels, string_agg(pred, ' ' order by pos) as pred
            from held_tokens group by lang, row_id, line_no""", _held()),
        "bio_spans": v("""select lang || '-' || row_id || '-' || line_no as guid, type, "start", "end" from p_spans""", _spans("p", "pred")),
        "ner_metrics": v("""
            with hits as (select g.type, count(*) as t from g_spans g join p_spans p using (row_id, line_no, type, "start", "end") group by g.type),
            s as (
              select type, coalesce(g, 0) as g, coalesce(p, 0) as p, coalesce(t, 0)::double as t
              from (select type, count(*) as g from g_spans group by type) full join (select type, count(*) as p from p_spans group by type) using (type)
              left join hits using (type)),
            r as (select type, g, p, t, case when p > 0 then t / p else 0 end as pr, case when g > 0 then t / g else 0 end as re,
              case when g + p > 0 then 2 * t / (g + p) else 0 end as f from s)
            select type, round(pr, 6) as precision, round(re, 6) as recall, round(f, 6) as f1, g::bigint as support from r
            union all select 'micro avg', round(sum(t) / sum(p), 6), round(sum(t) / sum(g), 6), round(2 * sum(t) / (sum(g) + sum(p)), 6), sum(g)::bigint from r
            union all select 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), sum(g)::bigint from r
            union all select 'weighted avg', round(sum(pr * g) / sum(g), 6), round(sum(re * g) / sum(g), 6), round(sum(f * g) / sum(g), 6), sum(g)::bigint from r
            """.replace("with hits", "select * from (with hits", 1) + ")", {**_held(), **_spans("p", "pred", "held_tokens"), **_spans("g", "tag", "held_tokens")}),
        "prediction_export": v(f"""
            select m.file, m.line_no, case when length(trim(m.line)) < 2 or m.line like '-DOCSTART-%' then m.line
                else t.word || ' ' || coalesce(x.tag, 'O') end as out_line,
              case when length(trim(m.line)) < 2 then 'boundary' when m.line like '-DOCSTART-%' then 'document' else 'token' end as status
            from conll_marked m join splits s on s.lang = m.file and s.row_id = m.line_no // {DOC_SHIFT}
            left join conll_tokens t on t.file = m.file and t.line_no = m.line_no left join lexicon x on x.lang = t.file and x.word = t.word
            where s.split = 'eval'""", conll),
        "run_grid": v(f"""
            select task, lang, seed::bigint as seed from (select distinct lang from corpus),
              (select unnest({TASKS}) as task), (select unnest({SEEDS}) as seed)"""),
        "seed_summary": v("""
            select coalesce(task, 'all') as task, coalesce(lang, 'all') as lang, count(*) as n, round(avg(v), 6) as mean,
              round(stddev_samp(v), 6) as std
            from (select task, lang, seed, avg(value) as v from runs group by all) group by grouping sets ((task, lang), (task), ())"""),
        "checkpoint_compare": v(f"""
            select task, lang, step || '_f1' as name, value,
              case when row_number() over (partition by task, lang order by value desc, step) = 1 then 1 else 0 end as is_best
            from ({RUN_SCORES})"""),
    }
    return out


def _shards() -> dict[str, str]:
    return {"shards": """
        select lang, row_id, line_no, cast(floor((idx - 1) / ceil(total / 6.0::double)) as bigint) as shard_id from (
          select *, row_number() over (partition by lang order by digest, row_id, line_no) as idx, count(*) over (partition by lang) as total
          from train_lines)"""}


def _batches() -> dict[str, str]:
    return {
        "batch_rows": f"""
            select lang, row_id, line_no, n, (rn - 1) // 64 as j, (rn - 1) % 64 as batch_pos from (
              select *, row_number() over (partition by lang order by md5('{SEED}|batch|' || row_id || '|' || line_no), row_id, line_no) as rn,
                count(*) over (partition by lang) as n from train_lines)""",
        "batch_heads": """
            select lang, j, round(n / (select count(*)::double from train_lines), 12) as p from batch_rows where batch_pos = 0""",
        "batch_times": f"""
            select lang, j, sum(cast(round(-ln(({h32(f"'{SEED}|' || lang || '|' || j")} + 1) / 4294967297::double) / p * 1000000) as bigint))
              over (partition by lang order by j) as t from batch_heads""",
        "batch_order": "select lang, j, row_number() over (order by t, lang, j) as batch_id from batch_times",
    }
