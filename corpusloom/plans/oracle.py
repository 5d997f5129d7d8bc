"""The registered queries in SQL, written from their definition for a second engine."""

from __future__ import annotations

import re

from corpusloom.functions.text import ENGLISH_STOP_WORDS
from corpusloom.operators.curation import CLAUSE_LABELS
from corpusloom.plans import parameters as P

# the words of text functions, for an engine whose classes are ASCII only
WORD_PATTERN = (
    r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)

# draws by the digest of a seed and the id
PLACE = "cast('0x'||substr(md5('split:'||doc_id),1,8) as bigint)%10"
SPLIT = f"case when {PLACE}<8 then 'train' when {PLACE}=8 then 'validation' else 'test' end"
GOLD = "cast(cast('0x'||substr(md5('gold:'||doc_id),1,8) as bigint)%5 as int)"

# --- views, inlined as common table expressions --------------------------------

VIEWS = {
    "v_gold": """
        select doc_id, list_filter([case when quality=1 then 0 end, case when toxic=1 then 1 end],
          lambda x: x is not null) labels from labels""",
    "v_scores": """
        select doc_id, [cast((doc_id*37+n_chars*11)%200-90 as double)/40,
          cast((doc_id*53+n_chars*7)%200-120 as double)/40] scores from documents""",
    "v_scored": "select g.doc_id, g.labels, s.scores from v_gold g join v_scores s on g.doc_id=s.doc_id",
    "v_indicators": """
        select doc_id, unnest([0,1]) as label, unnest(scores) as x,
          unnest([cast(list_contains(labels,0) as int), cast(list_contains(labels,1) as int)]) as y from v_scored""",
    "v_marks": "select doc_id, label, x, y, cast(1/(1+exp(-x)) > 0.5 as int) as p from v_indicators",
    "v_zero_marks": """
        select doc_id, label, y, p from v_marks union all
        select doc_id, 2, cast(max(y)=0 as int), cast(max(p)=0 as int) from v_marks group by doc_id""",
    "v_multiclass": """
        select doc_id, cast(list_position(['de','en','es','fr'], lang)-1 as int) as label,
          [cast((doc_id*(31+7*k)+n_chars*(13+4*k))%100 as double)/40 for k in range(0,4)] scores from documents""",
    "v_classified": "select *, cast(list_position(scores, list_max(scores))-1 as int) as pred from v_multiclass",
    "v_class_f1": """
        select c.label, sum(case when r.label=c.label and r.pred=c.label then 1 else 0 end) tp,
          sum(case when r.label<>c.label and r.pred=c.label then 1 else 0 end) fp,
          sum(case when r.label=c.label and r.pred<>c.label then 1 else 0 end) fn
        from v_classified r cross join (select label from v_classified union select pred from v_classified) c
        group by c.label""",
    "v_choice": f"""
        select d.doc_id, d.text as context, k.k as choice, {GOLD} as label,
          b.text || case when k.k={GOLD} then ' foregone conclusion reached' else ' unlikely outcome described' end as ending
        from documents d cross join range(5) k(k) join benchmark b
          on b.item_id=(d.doc_id+k.k*7)%(select count(*) from benchmark)""",
    "v_orders_brands": """
        select o.o_orderkey, list_sort(list(distinct p.p_brand)) labels, cast(year(o.o_orderdate) as varchar) as year
        from orders o join lineitem l on l.l_orderkey=o.o_orderkey join part p on p.p_partkey=l.l_partkey
        group by o.o_orderkey, o.o_orderdate""",
    "v_label_rows": "select o_orderkey, year, unnest(labels) as label from v_orders_brands",
    "v_top_labels": f"""
        select label, count(*) n from v_label_rows group by label order by n desc, label limit {P.TOP_LABELS}""",
    "v_single": """
        select o_orderkey, min(label) as label, year from v_label_rows
        where label in (select label from v_top_labels) group by o_orderkey, year having count(*)=1""",
    "v_sampled": """
        select * from (select *, row_number() over (partition by year order by md5(concat('1:', o_orderkey)), o_orderkey) r
          from v_single) where r <= case year {sizes} else 0 end""".format(
        sizes=" ".join(f"when '{y}' then {n}" for y, n in P.YEAR_SAMPLES.items())
    ),
    "v_sentences": """
        select source as company, doc_id, line_no, text from (select source, doc_id,
          unnest(range(len(l))) line_no, unnest(l) as text
          from (select *, string_split(text, chr(10)) l from documents))""",
    "v_annotations": """
        select v.company, v.doc_id, v.line_no, t.label_type,
          case when (v.doc_id*5+v.line_no*3+t.label_type)%11=0 then '1' else '0' end as value
        from v_sentences v cross join range(8) t(label_type)""",
    "v_label_names": "select unnest(range(8)) label_type, unnest([{}]) as label_name".format(
        ", ".join(f"'{name}'" for name in CLAUSE_LABELS)
    ),
    "v_companies": """
        select distinct source as company, cast(2006 + cast(substring(source,4) as int)%12 as varchar) as year
        from documents""",
    "v_raw_lines": """
        select doc_id, concat(case when doc_id%7=0 then '' else cast(doc_id as varchar) end, ',',
          replace(text,chr(10),' '), ',', case when doc_id%6=0 then 'x' else cast(doc_id%5 as varchar) end) as value
        from documents""",
    "v_all_runs": """
        select model, task, seed, case when q%11<>0 then cast(q%1000 as double)/1000 end as eval_macro_f1,
          cast(e%997+1 as double)/1000 as predict_macro_f1, cast((q*7)%991 as double)/1000 as eval_micro_f1,
          cast((e*3)%983+1 as double)/1000 as predict_micro_f1
        from (select l_suppkey%8 as model, l_partkey%7 as task, cast((l_linenumber-1)%5+1 as int) as seed,
            cast(sum(cast(floor(l_quantity) as bigint)) as bigint) q,
            cast(sum(cast(floor(l_extendedprice) as bigint)) as bigint) e
          from lineitem group by 1, 2, 3)""",
    "v_runs": "select * from v_all_runs where eval_macro_f1 is not null",
    "v_ranked": "select *, row_number() over (partition by model, task order by eval_macro_f1 desc, seed) as rank from v_runs",
    "v_grid": f"""
        select cast(m as int) as model, cast(t as int) as task, cast(s as int) as seed
        from range({len(P.MODELS)}) a(m), range({len(P.TASKS)}) b(t), range(1,{len(P.SEEDS) + 1}) c(s)""",
    "v_board": """
        select g.model, g.task, r.eval_micro_f1, r.eval_macro_f1, r.predict_micro_f1, r.predict_macro_f1
        from (select distinct model, task from v_grid) g
        left join v_ranked r on r.model=g.model and r.task=g.task and r.rank=1""",
    "v_cells": """
        select model, task, printf('%.1f', predict_micro_f1*100) || ' / ' || printf('%.1f', predict_macro_f1*100) as cell
        from v_board""",
    "v_epochs": """
        select task, model, seed, epoch, cast(c%1000 as double)/1000 as metric, c//100+1 as runtime
        from (select event_type as task, user_id%7 as model, user_id%5+1 as seed, cast(day(ts) as int) as epoch,
          cast(sum(cast(floor(value*100) as bigint)) as bigint) c from events group by 1, 2, 3, 4)""",
    "v_last_entries": """
        select task, model, seed, cast(count(*) as double) as epochs, cast(sum(runtime) as double) as runtime
        from v_epochs group by task, model, seed""",
    "v_times": """
        select task, model, round(avg(runtime),9) runtime, round(avg(runtime/epochs),9) time_per_epoch,
          round(avg(epochs),9) epochs_mean, round(stddev_pop(epochs),9) epochs_std
        from v_last_entries group by task, model""",
    "v_numbered": """
        select *, row_number() over w as n, coalesce(metric > max(metric) over
          (partition by task, model, seed order by epoch rows between unbounded preceding and 1 preceding), true) as gain
        from v_epochs window w as (partition by task, model, seed order by epoch)""",
    "v_waiting": f"""
        select *, n - max(case when gain then n end) over
          (partition by task, model, seed order by epoch rows unbounded preceding) >= {P.PATIENCE} as stops from v_numbered""",
    "v_stopping": """
        select *, min(case when stops then epoch end) over (partition by task, model, seed) as stop_epoch from v_waiting""",
    "v_doc_tokens": r"select doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') toks from documents",
    "v_token_ids": f"""
        select token, 1 + row_number() over (order by n desc, token) as token_id from (
          select token, count(*) n from (select unnest(toks) as token from v_doc_tokens) group by token
          order by n desc, token limit {P.TOKEN_VOCABULARY})""",
    "v_grams": """
        select doc_id, unnest(list_concat(t,
          [t[i] || ' ' || t[i+1] for i in range(1, greatest(len(t), 1))],
          [t[i] || ' ' || t[i+1] || ' ' || t[i+2] for i in range(1, greatest(len(t)-1, 1))])) as term
        from (select doc_id, list_filter(toks, lambda x: not list_contains([{}], x)) t from v_doc_tokens)""".format(
        ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)
    ),
    "v_counts": "select doc_id, term, count(*) tf from v_grams group by doc_id, term",
    "v_vocabulary": f"""
        select cast(row_number() over (order by term)-1 as int) as index, term, tf, df,
          ln((1+(select count(*) from documents))/(1.0::double+df))+1 as idf
        from (select term, cast(sum(tf) as bigint) tf, count(*) df from v_counts group by term having count(*)>=5
          order by tf desc, term limit {P.MAX_FEATURES})""",
    "v_split_counts": f"select *, {SPLIT} as split from v_counts",
    "v_train_vocabulary": f"""
        select term, ln((1+(select count(*) from documents where {SPLIT}='train'))/(1.0::double+count(*)))+1 as idf
        from v_split_counts where split='train' group by term having count(*)>=5
        order by sum(tf) desc, term limit {P.MAX_FEATURES}""",
    "v_parts": f"select doc_id, regexp_split_to_array(text, '{P.SEGMENT_PATTERN}') l from documents",
    "v_segments": f"""
        select doc_id, cast(i-1 as int) as segment, l[i] as text
        from v_parts, lateral (select unnest(range(1, least(len(l), {P.SEGMENTS})+1)) as i)""",
}



def with_views(body: str) -> str:
    """The statement with the views it names, and those they name, in front."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\bv_\w+", sql):
            if name not in ordered:
                visit(VIEWS[name])
                ordered.append(name)

    visit(body)
    heads = ",\n".join(f"{name} as ({VIEWS[name]})" for name in ordered)
    return f"with {heads}\n{body}"


F1_LABELS = """
    select round(coalesce(2.0*sum(tp)/nullif(2*sum(tp)+sum(fp)+sum(fn),0),0),9) micro_f1,
      round(avg(coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0)),9) macro_f1 from ({counts})"""


def label_counts(view: str, by: str = "") -> str:
    keys = f"{by}, label" if by else "label"
    return (
        f"select {keys}, sum(y*p) tp, sum((1-y)*p) fp, sum(y*(1-p)) fn from {view} group by {keys}"
    )


GLOBAL_MASK = ",".join(["1"] + ["0"] * (P.SEQUENCE - 1))
N = P.PAIR_BUDGET
SCORES = ("eval_micro_f1", "eval_macro_f1", "predict_micro_f1", "predict_macro_f1")


def pct(x: str) -> str:
    return f"printf('%.1f', {x}*100)"


def clock(x: str) -> str:
    whole = f"cast(floor(round({x}, 6)) as bigint)"
    hms = f"printf('%d:%02d:%02d', {whole}%86400//3600, {whole}%3600//60, {whole}%60)"
    return (
        f"case when {whole}//86400=0 then {hms} when {whole}//86400=1 then '1 day, ' || {hms}"
        f" else {whole}//86400 || ' days, ' || {hms} end"
    )


ORACLE = {
    "eval_multilabel_f1": with_views(F1_LABELS.format(counts=label_counts("v_zero_marks"))),
    "eval_multilabel_f1_no_zero_class": with_views(F1_LABELS.format(counts=label_counts("v_marks"))),
    "eval_multilabel_f1_by_split": with_views("select split, round(2.0*sum(tp)/nullif(2*sum(tp)+sum(fp)+sum(fn),0),9) micro_f1,"
        " round(sum(coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0))/3,9) macro_f1 from ("
        f"select {SPLIT} as split, label, sum(y*p) tp, sum((1-y)*p) fp, sum(y*(1-p)) fn from v_zero_marks group by 1, 2"
        ") group by split",
    ),
    "eval_label_confusion": with_views("select cast(label as int) as label, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn,"
        f" round(coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0),9) f1 from ({label_counts('v_zero_marks')})",
    ),
    "eval_indicator_rows": with_views("select doc_id, string_agg(y, ',' order by label) gold, string_agg(p, ',' order by label) pred"
        " from v_zero_marks group by doc_id",
    ),
    "eval_subset_accuracy": with_views("select round(avg(hit),9) accuracy from (select doc_id, cast(bool_and(y=p) as int) hit from v_marks group by doc_id)",
    ),
    "eval_alignment": with_views("select count(g.doc_id) filter (s.doc_id is not null) matched, count(g.doc_id) filter (s.doc_id is null) gold_only,"
        " count(s.doc_id) filter (g.doc_id is null) predicted_only from v_gold g full join v_scores s on g.doc_id=s.doc_id",
    ),
    "eval_multiclass_f1": with_views("select (select round(avg(cast(label=pred as int)),9) from v_classified) micro_f1,"
        " round(avg(2.0*tp/(2*tp+fp+fn)),9) macro_f1 from v_class_f1 ",
    ),
    "eval_multiclass_counts": with_views("select label, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn from v_class_f1 ",
    ),
    "eval_metrics_long": with_views("select 'micro_f1' as metric, round(avg(cast(label=pred as int)),9) as value from v_classified union all"
        " select 'accuracy', round(avg(cast(label=pred as int)),9) from v_classified union all"
        " select 'macro_f1', round(avg(2.0*tp/(2*tp+fp+fn)),9) from v_class_f1 ",
    ),
    "eval_choice_argmax": with_views("select doc_id, label, cast(arg_max(choice, s*100-choice) as int) predicted from ("
        "select doc_id, label, choice, (length(ending)*(choice+3)+doc_id*13)%101 s from v_choice ) group by doc_id, label",
    ),
    "eval_bce_loss": with_views("select round(avg(greatest(x,0)-x*y+ln(1+exp(-abs(x)))),9) loss from v_marks "
    ),
    "eval_ce_loss": with_views("select round(avg(ln(list_sum([exp(x) for x in scores]))-scores[label+1]),9) loss from v_multiclass where label<>3",
    ),
    "eval_soft_ce_loss": with_views("select round(avg(ln(list_sum([exp(x) for x in scores]))-0.1*list_sum(scores)-0.6*scores[label+1]),9) loss"
        " from v_multiclass ",
    ),
    "eval_mse_loss": with_views("select round(avg((scores[1]-label)*(scores[1]-label)),9) loss from v_multiclass "
    ),
    "zero_class_docs": "select doc_id from documents where doc_id not in (select doc_id from labels where quality=1 or toxic=1)",
    "label_validation": with_views("select count(*) filter (label between 0 and 2) known, count(*) filter (not (label between 0 and 2)) unknown"
        " from v_multiclass ",
    ),
    "predictions_tsv": with_views("select doc_id, concat_ws(chr(9), doc_id, printf('%.5f', scores[1]), printf('%.5f', scores[2])) line from v_scored ",
    ),
    "curate_label_counts": with_views("select label, count(*) n from v_label_rows group by label"),
    "curate_top_labels": with_views("select label, n from v_top_labels "),
    "curate_label_pairs": with_views("select label, o_orderkey from v_label_rows where label in (select label from v_top_labels )",
    ),
    "curate_single_label": with_views("select o_orderkey, label, year from v_single "),
    "curate_year_sample_split": with_views("select o_orderkey, label, year, case year when '1999' then 'validation' when '2000' then 'test' when '2001' then 'test' else 'train' end"
        " as split from v_sampled ",
    ),
    "curate_chrono_group_split": with_views("select s.company, s.doc_id, cast(s.line_no as int) line_no, s.text, c.year as release_year, c.split"
        f" from v_sentences s join (select *, case when r<={P.N_TRAIN_GROUPS} then 'train'"
        f" when r<={P.N_TRAIN_GROUPS + P.N_VALIDATION_GROUPS} then 'validation' else 'test' end as split from"
        " (select *, row_number() over (order by year, company) r from v_companies )) c on s.company=c.company",
    ),
    "curate_positional_labels": with_views("select s.company, s.doc_id, cast(s.line_no as int) line_no, any_value(s.text) as text,"
        " coalesce(string_agg(n.label_name, '|' order by n.label_type),'') labels from v_sentences s"
        " left join v_annotations a on a.doc_id=s.doc_id and a.line_no=s.line_no and a.company=s.company and a.value='1'"
        " left join v_label_names n on n.label_type=a.label_type group by s.company, s.doc_id, s.line_no",
    ),
    "curate_annotation_counts": with_views("select 'sentences' as measure, count(*) n from v_sentences union all"
        " select label_name, count(a.value) from v_label_names n left join v_annotations a on a.label_type=n.label_type"
        " and a.value='1' group by label_name union all"
        " select 'annotations', count(*) from v_annotations where value='1' union all"
        " select 'sentences minus annotations', (select count(*) from v_sentences )-count(*) from v_annotations where value='1'"
        " union all select 'without annotation', count(*) from v_sentences s where not exists (select 1 from v_annotations a"
        " where a.value='1' and a.company=s.company and a.doc_id=s.doc_id and a.line_no=s.line_no)",
    ),
    "curate_wellformed_lines": with_views(r"select doc_id, value from v_raw_lines where regexp_matches(value, '(?s)^\p{Nd}.*\p{Nd}\z')"
        " and length(value)+1<5000",
    ),
    "curate_first_year": with_views("select company, coalesce(arg_min(year, doc_id*1000000+line_no), '-') as year from (select company, doc_id, line_no,"
        " nullif(regexp_extract(case when (doc_id+line_no)%9=0 then concat(text,' ',2000+doc_id%23) else text end,"
        " '20[0-2][0-9]'),'') as year from v_sentences ) group by company",
    ),
    "curate_brackets": with_views("select company, doc_id, cast(line_no as int) line_no, replace(replace(replace(text,'the','-lrb-the-rrb-'),"
        "'-lrb-','('),'-rrb-',')') as text from v_sentences ",
    ),
    "curate_dataset_card": with_views("select task, count(*) filter (split='train') train, count(*) filter (split='validation') validation,"
        " count(*) filter (split='test') test, cast(max(c) as bigint) n_classes from ("
        f"select 'multilabel' as task, {SPLIT} as split,"
        " (select count(distinct l) from (select unnest(labels) l from v_gold )) c from v_gold union all"
        f" select 'multiclass', {SPLIT}, (select count(distinct label) from v_multiclass ) from v_multiclass union all"
        f" select 'choice', {SPLIT}, (select count(distinct {GOLD}) from documents) from documents) group by task",
    ),
    "text_first_n_words": f"""
        select doc_id, array_to_string(w[1:{P.FIRST_WORDS}],' ') head,
          array_to_string(w[1:greatest(len(w)-1,0)],' ') all_but_last, cast(len(w) as int) n_words,
          cast(length(text) as int) n_chars
        from (select *, regexp_extract_all(text, '{WORD_PATTERN}') w from documents)""",
    "text_segments": with_views("select doc_id, segment, text from v_segments "),
    "text_long_document": with_views(f"select doc_id, string_agg(array_to_string(regexp_extract_all(text, '{WORD_PATTERN}')[1:{P.SEGMENT_WORDS}],' '),"
        " ' [SEP] ' order by segment) as text from v_segments group by doc_id",
    ),
    "text_joined_segments": f"select doc_id, regexp_replace(text, '{P.SEGMENT_PATTERN}', ' ', 'g') as text from documents",
    "text_pad_mask": with_views(f"""select doc_id, concat_ws(',', ids, nullif(array_to_string([0 for i in range({P.SEQUENCE}-n)],','),'')) input_ids,
          concat_ws(',', nullif(array_to_string([1 for i in range(n)],','),''),
            nullif(array_to_string([0 for i in range({P.SEQUENCE}-n)],','),'')) attention_mask,
          '{GLOBAL_MASK}' as global_attention_mask
        from (select doc_id, string_agg(coalesce(v.token_id,1), ',' order by pos) filter (d.token is not null) ids,
          count(d.token) n from (select doc_id, unnest(case when len(toks)=0 then [null] else toks[1:{P.SEQUENCE}] end) token,
            unnest(range(greatest(least(len(toks),{P.SEQUENCE}),1))) pos from v_doc_tokens ) d
          left join v_token_ids v on v.token=d.token group by doc_id)""",
    ),
    "text_segment_matrix": with_views(rf"""select g.doc_id, cast(g.segment as int) segment, case when n>0 then cast(g.segment+1 as int) else 0 end as position,
          concat_ws(',', ids, nullif(array_to_string([0 for i in range({P.SEGMENT_WORDS}-coalesce(n,0))],','),'')) input_ids
        from (select doc_id, unnest(range({P.SEGMENTS})) as segment from documents) g left join
        (select doc_id, segment, string_agg(coalesce(v.token_id,1), ',' order by pos) ids, count(*) n from
          (select doc_id, segment, unnest(t) token, unnest(range(len(t))) pos from (select doc_id, segment,
            regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')[1:{P.SEGMENT_WORDS}] t from v_segments )) d
          left join v_token_ids v on v.token=d.token group by doc_id, segment) s
        on s.doc_id=g.doc_id and s.segment=g.segment""",
    ),
    "text_pair_truncate": with_views(f"""select doc_id, cast(choice as int) choice, cast(a2 as int) context_words, cast(b2 as int) choice_words,
          array_to_string([case when i>=a2 and i<a2+b2 then 1 else 0 end for i in range({N})],',') token_types
        from (select *, case when a+b<={N} then a when a<={N // 2} then a when b<={N // 2} then {N}-b else {N - N // 2} end a2,
          case when a+b<={N} then b when a<={N // 2} then {N}-a when b<={N // 2} then b else {N // 2} end b2
        from (select doc_id, choice, len(regexp_extract_all(context, '{WORD_PATTERN}')) a,
          len(regexp_extract_all(ending, '{WORD_PATTERN}')) b from v_choice ))""",
    ),
    "text_pair_length_stats": with_views("select count(*) n_pairs, round(avg(n),9) mean_words, cast(median(n) as double) median_words from"
        f" (select len(regexp_extract_all(context || ' ' || ending, '{WORD_PATTERN}')) n from v_choice )",
    ),
    "text_identifiers": """
        select page_id, split_part(list_last(string_split(url,'/')),'.',1) stem,
          array_to_string([upper(w[1]) || w[2:] for w in string_split(regexp_replace(url,'[^a-z]+',' ','g'),' ')],'') identifier,
          upper(url) heading from pages""",
    "text_batched_map": f"""
        select doc_id, len(w) as n_tokens, coalesce(w[len(w)], '') as last_token
        from (select doc_id, regexp_extract_all(text, '{WORD_PATTERN}') w from documents)""",
    "tfidf_ngram_counts": with_views("select d.doc_id, cast(coalesce(sum(tf),0) as int) n_terms, cast(count(term) as int) n_distinct"
        " from documents d left join v_counts c on c.doc_id=d.doc_id group by d.doc_id",
    ),
    "tfidf_vocabulary": with_views("select index, term, tf, df from v_vocabulary "),
    "tfidf_idf": with_views("select term, round(idf,9) idf from v_vocabulary "),
    "tfidf_weights": with_views("select doc_id, term, round(w/sqrt(sum(w*w) over (partition by doc_id)),9) weight from"
        " (select c.doc_id, c.term, c.tf*v.idf w from v_counts c join v_vocabulary v on v.term=c.term)",
    ),
    "svm_features": with_views("select doc_id, term, round(w/sqrt(sum(w*w) over (partition by doc_id)),9) weight from"
        " (select c.doc_id, c.term, c.tf*v.idf w from v_split_counts c join v_train_vocabulary v on v.term=c.term"
        " where c.split<>'train')",
    ),
    "svm_choice_predictions": f"select doc_id, {SPLIT} as split, {GOLD} as predicted from documents where {SPLIT}<>'train'",
    "svm_choice_classes": f"select {SPLIT} as split, {GOLD} as label, count(*) as n from documents group by 1, 2",
    "svm_best_point": f"""
        select cast(l_partkey%{3 * len(P.SVM_VOCABULARY_SIZES)} as int) as grid_index,
          cast(cast(sum(cast(floor(l_quantity) as bigint)) as bigint)%3 as double)/4 as score
        from lineitem group by 1 order by score desc, grid_index limit 1""",
    "svm_over_seeds": with_views("select model || '-' || task as split, count(*) n_seeds,"
        " round(avg(predict_micro_f1),9) micro_f1_mean, round(stddev_pop(predict_micro_f1),9) micro_f1_std,"
        " round(avg(predict_macro_f1),9) macro_f1_mean, round(stddev_pop(predict_macro_f1),9) macro_f1_std"
        " from v_all_runs group by 1",
    ),
    "vec_max_pool": """
        select label, cast(dim as int) dim, round(cast(max(x) as double),6) as x from (select label,
          unnest(range(len(embedding))) dim, unnest(embedding) x from embeddings) group by label, dim""",
    "vec_position_encode": """
        select vec_id, cast(vec_id%65 as int) as position, cast(i as int) dim, round(cast(x as double) +
          case when vec_id%65=0 then 0 when i%2=0 then sin((vec_id%65)/pow(10000.0,2.0*i/64))
          else cos((vec_id%65)/pow(10000.0,2.0*i/64)) end,6) as x
        from (select vec_id, unnest(range(len(embedding))) i, unnest(embedding) x from embeddings)""",
    "board_topk_seeds": with_views("select model, task, seed, eval_macro_f1, predict_macro_f1, eval_micro_f1, predict_micro_f1,"
        f" cast(rank as int) as rank from v_ranked where rank<={P.TOP_SEEDS}",
    ),
    "board_seed_summary": with_views("select model, task, count(*) n_seeds, "
        + ", ".join(f"round(avg({s}),9) {s}_mean, round(stddev_pop({s}),9) {s}_std" for s in SCORES)
        + " from v_runs group by model, task",
    ),
    "board_dev_topk_test_best": with_views("select model, task, "
        + ", ".join(f"round(avg({s}),9) {s}_mean, round(stddev_pop({s}),9) {s}_std" for s in SCORES[:2])
        + ", "
        + ", ".join(f"round(max({s}) filter (rank=1),9) {s}" for s in SCORES[2:])
        + f" from v_ranked where rank<={P.TOP_SEEDS} group by model, task",
    ),
    "board_means": with_views(" union all ".join(
            f"""select model, '{s}' as measure, case when count({s})=count(*) then round(avg({s}),9) end arithmetic,
            case when count({s})=count(*) then case when min({s})=0 then 0 else round(count(*)/sum(1/nullif({s},0)),9) end
              end harmonic,
            case when count({s})=count(*) then case when min({s})=0 then 0 else round(exp(avg(ln(nullif({s},0)))),9) end
              end geometric
            from v_board group by model"""
            for s in SCORES
        ),
    ),
    "board_pivot": with_views("select model, "
        + ", ".join(f"max(cell) filter (task={t}) task_{t}" for t in P.TASKS)
        + ", 'model-' || case when model=7 then 1 else model end as name from v_cells group by model",
    ),
    "board_table_lines": with_views("select model, '<tr><td>model-' || case when model=7 then 1 else model end || '</td>' ||"
        " string_agg('<td>' || coalesce(cell,'nan / nan') || '</td>', '' order by task) || '</tr>' line"
        " from v_cells group by model",
    ),
    "board_report_lines": with_views(f"select model, task, seed, 'MICRO-F1: ' || {pct('eval_micro_f1')} || chr(9) || 'MACRO-F1: ' || {pct('eval_macro_f1')}"
        f" || chr(9) || ' | MICRO-F1: ' || {pct('predict_micro_f1')} || chr(9) || 'MACRO-F1: ' ||"
        f" {pct('predict_macro_f1')} as line from v_runs ",
    ),
    "board_summary_lines": with_views("select model, task, 'MICRO-F1: ' || {} || chr(9) || ' ± ' || {} || chr(9) || 'MACRO-F1: ' || {} || chr(9) ||"
        " ' ± ' || {} || chr(9) || ' | MICRO-F1: ' || {} || chr(9) || 'MACRO-F1: ' || {} as line"
        " from v_ranked where rank<={} group by model, task".format(
            pct("round(avg(eval_micro_f1),9)"),
            pct("round(stddev_pop(eval_micro_f1),9)"),
            pct("round(avg(eval_macro_f1),9)"),
            pct("round(stddev_pop(eval_macro_f1),9)"),
            pct("max(predict_micro_f1) filter (rank=1)"),
            pct("max(predict_macro_f1) filter (rank=1)"),
            P.TOP_SEEDS,
        ),
    ),
    "board_missing_runs": with_views("select model, task, seed from v_grid g where not exists (select 1 from v_runs r where r.model=g.model"
        " and r.task=g.task and r.seed=g.seed)",
    ),
    "board_train_time": with_views("select upper(task) heading, model, runtime, time_per_epoch, epochs_mean, epochs_std, 'TRAIN TIME: ' ||"
        f" {clock('runtime')} || chr(9) || ' TIME/EPOCH: ' || {clock('time_per_epoch')} || chr(9) || ' EPOCHS: ' ||"
        " printf('%.1f', epochs_mean) || ' ± ' || printf('%.1f', epochs_std) as line from v_times ",
    ),
    "log_early_stop": with_views("select task, model, seed, coalesce(min(stop_epoch), max(epoch)) stop_epoch, min(stop_epoch) is not null"
        " out_of_patience from v_stopping group by task, model, seed",
    ),
    "log_best_epoch": with_views("select task, model, seed, arg_max(epoch, metric*1000000-epoch) best_epoch, max(metric) metric from v_stopping"
        " where stop_epoch is null or epoch<=stop_epoch group by task, model, seed",
    ),
    "sample_first_n": f"select doc_id, text from documents order by doc_id limit {P.CAP}",
    "sample_preview": f"""
        select doc_id, cast(len(regexp_extract_all(text, '{WORD_PATTERN}')) as int) n_words
        from documents order by doc_id limit 2""",
    "sample_spot_check": "select doc_id, text from documents order by md5(concat('1:',doc_id)), doc_id limit 3",
    "sample_counts": f"""
        select split, count(*) n_rows, least({P.CAP}, count(*)) n_used
        from (select {SPLIT} as split from documents) group by split""",
    "io_split_json": with_views("select o_orderkey, label, year, case year when '1999' then 'validation' when '2000' then 'test' when '2001' then 'test' else 'train' end"
        " as split from v_sampled ",
    ),
    "io_task_split": f"select text, cast(doc_id%14 as int) as label, 'validation' as split from documents where {PLACE}=8",
    "io_choice_csv": with_views(rf"""select doc_id, cast(choice as int) choice,
          cast(len(regexp_extract_all(context || ' ' || ending, '{WORD_PATTERN}')) as int) n_words
        from (select *, sum(length('"' || replace(ending,'"','""') || '",')) over (partition by doc_id) + length(doc_id::varchar)
            + length('"' || replace(regexp_replace(context, '[\r\n]+', ' ', 'g'),'"','""') || '"') + 3 as n_line
          from (select doc_id, context, choice, regexp_replace(ending, '[\r\n]+', ' ', 'g') ending from v_choice ))
        where n_line+1<5000""",
    ),
    "io_json_records": with_views("select to_json({'o_orderkey': o_orderkey, 'labels': labels, 'year': year})::varchar as value from v_orders_brands ",
    ),
    "io_run_tree": with_views("select cast(task as varchar) as task, cast(model as varchar) as model, seed, eval_micro_f1,"
        " eval_macro_f1, predict_micro_f1, predict_macro_f1 from v_runs where (model+task+seed)%9<>0",
    ),
    "io_train_logs": with_views("select cast(task as varchar) as task, cast(model as varchar) as model,"
        " cast(seed as int) as seed, epochs, runtime from v_last_entries ",
    ),
    "io_feature_cache":
        f"select doc_id, cast(len(regexp_extract_all(text, '{WORD_PATTERN}')) as int) n_words from documents",
    "io_content_cache":
        f"select 'words' as state, doc_id, cast(len(regexp_extract_all(text, '{WORD_PATTERN}')) as int) n_words from documents",
    "io_guarded_output":
        f"select doc_id, cast(len(regexp_extract_all(text, '{WORD_PATTERN}')) as int) n_words, true as refused from documents",
    "io_keyed_lines": with_views("select 'doc' || doc_id as key, cast(line_no as int) as line_no,"
        " cast(length(text) as int) as n_chars from v_sentences ",
    ),
    "io_annotation_sets": with_views("""select 'item' || item_id as key, cast(line_no as int) as line_no, text,
          coalesce((select string_agg(label_name, '|' order by label_type) from v_label_names
            where (item_id*5+line_no*3+label_type)%11=0), '') as labels
        from (select item_id, unnest(range(len(w))) as line_no, unnest(w) as text
          from (select item_id, string_split(regexp_replace(text, '[\\r\\n]', ' ', 'g'), ' ') w from benchmark))""",
    ),
    "io_run_ledger": with_views("""select cast(g.task as varchar) as task, cast(g.model as varchar) as model, g.seed,
          case when r.model is null or (g.model+g.task+g.seed)%9=2 then 'absent'
            when (g.model+g.task+g.seed)%9=0 then 'cut off'
            when r.eval_macro_f1 is null then 'field missing'
            when (g.model+g.task+g.seed)%9=1 then 'wrong type' else 'counts' end as reason
        from v_grid g left join v_all_runs r on r.model=g.model and r.task=g.task and r.seed=g.seed""",
    ),
    "io_headed_lines": with_views("""select md5(value) as line_md5, regexp_full_match(value, '(?s)\\p{Nd}.*\\p{Nd}') as well_formed
        from (select regexp_replace(value, '[\\r\\n]', ' ', 'g') as value from v_raw_lines )""",
    ),
    "io_drifted_json": f"""select doc_id, case when split<>'train' then cast(length(text) as int) else -1 end as size,
          case when split<>'train' then lang end as lang, case when split='train' then lang end as language,
          cast(n_chars as varchar) as n_chars_text
        from (select *, {SPLIT} as split from documents)""",
}
