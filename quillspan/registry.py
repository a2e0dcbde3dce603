"""The registered queries of the core operators, and the same results in DuckDB's SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import text as fn
from quillspan.functions.lexers import EXTENSIONS
from quillspan.operators import extract, graph, ranking, records, redaction
from quillspan.operators import units as code
from quillspan.plans import context
from quillspan.sources import files
from quillspan.sources.tables import checkpoint_dir, normal_path, table
from quillspan.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BUDGET = 4000

CURRENT = "cu as (select * from (select *, row_number() over (partition by unit_id order by ingested_at desc nulls last) _rn from code_units where unit_id is not null) where _rn = 1)"
PLANNED = "pu as (select * from (select *, row_number() over (partition by plan_id, ord order by recorded_at desc nulls last) _rn from planned_units where plan_id is not null and ord is not null) where _rn = 1)"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return keep


def _units(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return code.current_units(table(spark, sf_dir, "code_units"), list(columns))


def _words_sql(x: str) -> str:
    cased = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    return rf"list_filter(list_transform(regexp_split_to_array({cased}, '[^\p{{L}}\p{{N}}]+'), lambda w: lower(w)), lambda w: w <> '')"


def _stem_sql(w: str) -> str:
    rules = " ".join(f"when ends_with({w}, '{s}') and strlen({w}) >= {n + len(s)} then left({w}, length({w}) - {len(s)}) || '{p}'" for s, p, n in fn.SUFFIXES)
    return f"case when strlen({w}) <= 3 then {w} {rules} when ends_with({w}, 's') and not ends_with({w}, 'ss') and strlen({w}) >= 4 then left({w}, length({w}) - 1) else {w} end"


def _terms_sql(x: str) -> str:
    words = f"list_filter({_words_sql(x)}, lambda w: strlen(w) >= 2)"
    return f"list_sort(list_distinct(list_concat({words}, list_filter(list_transform({words}, lambda w: {_stem_sql('w')}), lambda w: strlen(w) >= 2))))"


def _score_sql() -> str:
    def best(col: str, t: str) -> str:
        near = f"len(list_filter({col}, lambda q: strlen(q) >= 4 and (starts_with(q, '{t}') or starts_with('{t}', q)))) > 0" if len(t) >= 4 else "false"
        return f"(case when list_contains({col}, '{t}') then 1e0 when {near} then 0.85e0 else 0e0 end)"

    terms = sorted(context.QUESTION.items())
    total = {
        k: " + ".join(["0e0", *[f"{factor * w!r}e0 * {best(c, t)}" for t, w in terms]]) for k, c, factor in (("name_score", "n", 4.0), ("doc_score", "d", 3.5), ("sig_score", "s", 1.5))
    }
    body = " + ".join(["0e0", *[f"case when {best('n', t)} + {best('d', t)} + {best('s', t)} = 0 then {0.8 * w!r}e0 * {best('b', t)} else 0e0 end" for t, w in terms]])
    parts = ", ".join(f"{v} as {k}" for k, v in total.items())
    return (
        f"tk as (select *, {_terms_sql('name')} n, {_terms_sql('doc_comment')} d, {_terms_sql('signature')} s, {_terms_sql('full_text')} b from cu), "
        f"pt as (select *, {parts}, {body} as body_score from tk), "
        "sc as (select *, round((name_score + doc_score + sig_score + body_score) / (1 + len(s) / 50e0), 6) as score from pt)"
    )


def _matched_sql() -> str:
    def hit(col: str, t: str) -> str:
        near = f"len(list_filter({col}, lambda q: strlen(q) >= 4 and (starts_with(q, '{t}') or starts_with('{t}', q)))) > 0" if len(t) >= 4 else "false"
        return f"list_contains({col}, '{t}') or {near}"

    return "list_filter([" + ", ".join(f"case when {' or '.join(hit(c, t) for c in 'ndsb')} then '{t}' end" for t in sorted(context.QUESTION)) + "], lambda t: t is not null)"


def _pack_ctes(source: str, budget: int = BUDGET, tag: str = "") -> str:
    """The packing of ``source`` (the units with a score) into ``pk``; ``tag`` tells one packing's parts from another's."""
    b, share = budget, budget * 60 // 100
    fits, u = f"p.used + o.s > {b}", "p.used"
    greedy = f"(o.n > 1 and o.f > {share} and {u} + o.f + (o.n - 1) * 15 > {b})"
    cases = [(fits, u, "'X'"), ("not o.cand", f"{u} + o.s", "'L'"), ("o.f <= o.s", f"{u} + o.s", "'G'"), (f"not {greedy} and {u} + o.f <= {b}", f"{u} + o.f", "'F'"), (f"o.c > o.s and {u} + o.c <= {b}", f"{u} + o.c", "'C'")]
    used = "case " + " ".join(f"when {c} then {x}" for c, x, _ in cases) + f" else {u} + o.s end"
    tier = "case " + " ".join(f"when {c} then {x}" for c, _, x in cases) + " else 'S' end"
    return f"""un{tag} as (select repo grp, unit_id, file, name, coalesce(start_line, 0) sl, score, greatest(0, coalesce(tok_full, 0)) f, greatest(0, coalesce(tok_compact, 0)) c, greatest(0, coalesce(tok_skeleton, 0)) s from {source} where repo is not null),
    gp{tag} as (select grp, max(score) > 0 pos from un{tag} group by grp),
    oa{tag} as (select u.*, (not pos or score > 0) cand, case when pos then 0 else row_number() over (partition by grp, file order by unit_id) end turn, case when pos then -score else 0e0 end rnk from un{tag} u join gp{tag} using (grp)),
    ob{tag} as (select *, row_number() over (partition by grp order by cand desc, turn, rnk, file nulls first, sl, name nulls first, unit_id) rn, count(*) filter (where cand) over (partition by grp) n from oa{tag}),
    pa{tag}(grp, rn, used, tier) as (select distinct grp, 0::bigint, 0::bigint, '' from ob{tag} union all select o.grp, o.rn, {used}, {tier} from pa{tag} p join ob{tag} o on o.grp = p.grp and o.rn = p.rn + 1),
    sk{tag} as (select o.grp, o.rn, o.c, o.s, row_number() over (partition by o.grp order by o.rn) k from pa{tag} p join ob{tag} o on o.grp = p.grp and o.rn = p.rn where tier = 'L' and o.c > o.s),
    q{tag}(grp, k, used, up) as (select grp, 0::bigint, max(used), false from pa{tag} group by grp union all select s.grp, s.k, case when q.used + s.c - s.s <= {b} then q.used + s.c - s.s else q.used end, q.used + s.c - s.s <= {b} from q{tag} q join sk{tag} s on s.grp = q.grp and s.k = q.k + 1),
    up{tag} as (select s.grp, s.rn from q{tag} q join sk{tag} s on s.grp = q.grp and s.k = q.k where up),
    pk{tag} as (select o.grp, o.unit_id, o.file, case when u.rn is not null or tier = 'C' then 'compact' when tier in ('F', 'G') then 'full' when tier in ('S', 'L') then 'skeleton' end inclusion,
      (case when u.rn is not null or tier = 'C' then o.c when tier in ('F', 'G') then o.f when tier in ('S', 'L') then o.s else 0 end)::bigint tokens,
      case when u.rn is not null then null when tier = 'L' then 'low_relevance' when tier = 'S' then 'budget_exhausted' end skeleton_reason,
      tier in ('F', 'G', 'C', 'S') and (case tier when 'C' then o.c when 'S' then o.s else o.f end) > {share} warned
      from pa{tag} p join ob{tag} o on o.grp = p.grp and o.rn = p.rn left join up{tag} u on u.grp = o.grp and u.rn = o.rn)"""


def _pack_sql(ranked: bool = True, budget: int = BUDGET) -> str:
    scores = _score_sql() if ranked else "sc as (select *, 0e0 as score from cu)"
    return f"recursive {CURRENT}, {scores}, {_pack_ctes('sc', budget)}"


@query("select lang, count(*) docs, sum(coalesce(ceil(strlen(text) / 4.0), 0))::bigint tokens from documents group by lang")
def token_estimate(spark, sf_dir):
    """Documents and estimated tokens per language."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.coalesce(fn.estimate_tokens(F.col("text")), F.lit(0))).alias("tokens"))


@query(
    r"""with r as (select doc_id, unnest(string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n')) line, generate_subscripts(string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n'), 1) i from documents where text is not null and text <> '')
    select doc_id, (1 + (i - 1) // 50)::int chunk, trim(first(line order by i), ' ') signature, count(*)::int n_lines, ceil(strlen(string_agg(line, chr(10) order by i)) / 4.0)::bigint tok_full from r group by doc_id, chunk"""
)
def chunk_units(spark, sf_dir):
    """Fifty-line chunks of all documents."""
    return code.chunk_texts(table(spark, sf_dir, "documents"))


@query(f"with {CURRENT} select unit_id, array_to_string({_words_sql('name')}, ' ') words from cu")
def split_identifiers(spark, sf_dir):
    """The words of every unit's name."""
    return _units(spark, sf_dir, "name").select("unit_id", F.array_join(fn.split_identifier(F.coalesce("name", F.lit(""))), " ").alias("words"))


@query(f"with {CURRENT}, t as (select unit_id, unnest({_terms_sql('signature')}) term from cu) select term, count(*) units from t group by term")
def signature_terms(spark, sf_dir):
    """In how many units' signatures each term or stem occurs."""
    terms = _units(spark, sf_dir, "signature").select(F.explode(fn.tokenize(F.coalesce("signature", F.lit("")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("units"))


@query(f"with {CURRENT}, {_score_sql()} select unit_id, score, round(name_score, 6) name_score, round(doc_score, 6) doc_score, round(sig_score, 6) sig_score, round(body_score, 6) body_score from sc")
def lexical_scores(spark, sf_dir):
    """Score parts of every unit for the question."""
    scored = context.scored_units(table(spark, sf_dir, "code_units"))
    return scored.select("unit_id", "score", *[F.round(c, 6).alias(c) for c in ("name_score", "doc_score", "sig_score", "body_score")])


@query(f"with {CURRENT}, {_score_sql()} select repo, unit_id, score from (select *, row_number() over (partition by repo order by score desc, unit_id) k from sc) where k <= 5")
def top_units(spark, sf_dir):
    """The five best units of each repository."""
    order = Window.partitionBy("repo").orderBy(F.desc("score"), "unit_id")
    return context.scored_units(table(spark, sf_dir, "code_units")).select("repo", "unit_id", "score", F.row_number().over(order).alias("k")).where("k <= 5").drop("k")


@query(f"with {_pack_sql()} select grp, unit_id, inclusion, tokens, skeleton_reason, warned from pk")
def budget_pack(spark, sf_dir):
    """Every unit's place in the packing of its repository."""
    return context.packed(table(spark, sf_dir, "code_units"), BUDGET).select("grp", "unit_id", "inclusion", "tokens", "skeleton_reason", "warned")


@query(f"with {_pack_sql()} select grp, coalesce(inclusion, 'left_out') tier, count(*) units, sum(tokens)::bigint tokens, count(*) filter (where warned) warnings from pk group by all")
def pack_tiers(spark, sf_dir):
    """Units, tokens and warnings per repository and tier."""
    plan = context.packed(table(spark, sf_dir, "code_units"), BUDGET)
    return plan.groupBy("grp", F.coalesce("inclusion", F.lit("left_out")).alias("tier")).agg(F.count("*").alias("units"), F.sum("tokens").alias("tokens"), F.count_if("warned").alias("warnings"))


@query(
    f"""with {_pack_sql()}, inc as (select pk.grp, pk.unit_id, pk.inclusion, cu.file, cu.start_line, cu.end_line, score, case inclusion when 'full' then full_text when 'compact' then compact_text else skeleton_text end txt from pk join cu using (unit_id) join (select unit_id, score from sc) using (unit_id) where inclusion is not null),
    kept as (select * from inc i where not exists (select 1 from inc o where o.inclusion = 'full' and o.grp = i.grp and o.file = i.file and o.unit_id <> i.unit_id and o.start_line <= i.start_line and o.end_line >= i.end_line and (o.start_line < i.start_line or o.end_line > i.end_line or i.inclusion <> 'full' or o.unit_id < i.unit_id)))
    select grp, file, greatest(max(score), 0e0) best, md5('// === ' || file || ' ===' || chr(10) || string_agg(coalesce(txt, '') || chr(10) || chr(10), '' order by coalesce(start_line, 0), unit_id)) payload_md5 from kept group by grp, file"""
)
def payloads(spark, sf_dir):
    """The digest of each file's rendered payload."""
    return context.payloads(table(spark, sf_dir, "code_units"), BUDGET).select("grp", "file", "best", F.md5("payload").alias("payload_md5"))


@query(f"with {_pack_sql(ranked=False)} select grp, unit_id, inclusion, tokens, skeleton_reason from pk")
def turns_pack(spark, sf_dir):
    """Every unit's place where nothing is scored: the files of a repository take turns."""
    return context.packed(table(spark, sf_dir, "code_units"), BUDGET, {}).select("grp", "unit_id", "inclusion", "tokens", "skeleton_reason")


TIGHT = 500


@query(f"with {_pack_sql(budget=TIGHT)} select grp, unit_id, tokens, round(tokens * 100 / {TIGHT}::double, 4) pct_of_budget from pk where warned")
def budget_warnings(spark, sf_dir):
    """Units that take more than six tenths of a tight budget."""
    plan = context.packed(table(spark, sf_dir, "code_units"), TIGHT).where("warned")
    return plan.select("grp", "unit_id", "tokens", F.round(F.col("tokens") * 100 / TIGHT, 4).alias("pct_of_budget"))


@query(f"with {CURRENT}, {_score_sql()}, m as (select unit_id, {_matched_sql()} terms from sc) select term, count(*) units from (select unnest(terms) term from m) group by term")
def matched_terms(spark, sf_dir):
    """In how many units each term of the question is matched."""
    scored = context.scored_units(table(spark, sf_dir, "code_units"))
    return scored.select(F.explode("matched_terms").alias("term")).groupBy("term").agg(F.count("*").alias("units"))


def _concepts_sql() -> str:
    rows = ", ".join(f"({n}, '{c}', '{near}')" for n, (callers, near) in enumerate(ranking.CONCEPTS) for c in callers.split())
    return f"cc(concept, caller, near) as (values {rows})"


@query(
    f"""with {CURRENT}, {_concepts_sql()}, ow as (select distinct unit_id, unnest({_terms_sql('name')}) term from cu),
    nr as (select distinct concept, unnest({_terms_sql('near')}) term from cc),
    wd as (select term word, {_stem_sql('term')} root from (select distinct term from ow)), cs as (select concept, caller, {_stem_sql('caller')} caller_stem from cc),
    ca as (select distinct word, concept from wd join cs on caller = word or caller_stem = root or starts_with(caller, root) or starts_with(root, caller)),
    al as (select unit_id, term, 1e0 weight from ow union all select o.unit_id, nr.term, 0.75e0 from (select distinct unit_id, concept from ow join ca on ow.term = ca.word) o join nr using (concept))
    select unit_id, term, max(weight) weight from al group by unit_id, term"""
)
def expanded_names(spark, sf_dir):
    """The words of every unit's name as a question, with those of the concepts they call up."""
    return ranking.expand_terms(_units(spark, sf_dir, "name"), "unit_id", "name")


LINKS = "lk as (select distinct caller_id, callee_id from graph_edges where caller_id is not null and callee_id is not null and caller_id <> callee_id)"


@query(
    f"""with {_pack_sql()}, {LINKS}, fu as (select unit_id from pk where inclusion = 'full'), pd as (select distinct callee_id unit_id from lk where caller_id in (select unit_id from fu) and callee_id not in (select unit_id from fu)),
    s2 as (select sc.* replace (round(score + case when pd.unit_id is null then 0e0 else 2.5e0 end, 6) as score) from sc left join pd using (unit_id)), {_pack_ctes('s2', tag='2')}
    select grp, coalesce(inclusion, 'left_out') tier, count(*) units, sum(tokens)::bigint tokens from pk2 group by all"""
)
def dependency_repack(spark, sf_dir):
    """The packing after the callees of full units got their boost."""
    plan = context.with_dependencies(table(spark, sf_dir, "code_units"), table(spark, sf_dir, "graph_edges"), BUDGET)
    return plan.groupBy("grp", F.coalesce("inclusion", F.lit("left_out")).alias("tier")).agg(F.count("*").alias("units"), F.sum("tokens").alias("tokens"))


@query(
    rf"""with {CURRENT}, c as (select unit_id, repo, file, call.callee as name, call.qualifier as qualifier, call.line as line from (select unit_id, repo, file, unnest(calls) as call from cu)),
    m as (select c.*, d.unit_id callee_id, case when lower(regexp_extract(d.file, '([^/]+?)(?:\.[^./]*)?$', 1)) = lower(c.qualifier) then 1 when d.file = c.file and d.unit_id <> c.unit_id then 2 when d.unit_id <> c.unit_id then 3 end rank
      from c join cu d on d.repo = c.repo and d.name = c.name and d.name not in ('', '<anonymous>')),
    f as (select *, min(rank) over w best, row_number() over (partition by repo, unit_id, name, qualifier, line order by rank, callee_id) k from m where rank is not null window w as (partition by repo, unit_id, name, qualifier, line))
    select distinct unit_id caller_id, callee_id, name callee_name, line from f where unit_id <> callee_id and ((best < 3 and k = 1) or (best = 3 and rank = 3))"""
)
def call_edges(spark, sf_dir):
    """Edges resolved from the calls of all units."""
    return graph.call_edges(_units(spark, sf_dir, "repo", "file", "name", "calls"))


@query(f"with {LINKS}, o as (select caller_id unit_id, count(*) callees from lk group by 1), i as (select callee_id unit_id, count(*) callers from lk group by 1) select unit_id, coalesce(callees, 0) callees, coalesce(callers, 0) callers from o full join i using (unit_id)")
def degree_stats(spark, sf_dir):
    """Different callees and callers per unit."""
    return graph.degrees(table(spark, sf_dir, "graph_edges"))


def _pagerank_sql(rounds: int = 20) -> str:
    steps = ["r0 as materialized (select unit_id, 1e0 / (select count(*) from nd) rank from nd)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} as materialized (select nd.unit_id, 0.15e0 / (select count(*) from nd) + 0.85e0 * coalesce(v, 0) rank from nd left join (select callee_id unit_id, sum(rank / degree) v from lo join r{k - 1} on r{k - 1}.unit_id = caller_id group by 1) using (unit_id))")
    return f"{LINKS}, nd as (select distinct unit_id from code_units where unit_id is not null), ll as (select * from lk where caller_id in (select unit_id from nd) and callee_id in (select unit_id from nd)), lo as (select ll.*, count(*) over (partition by caller_id) degree from ll), " + ", ".join(steps) + f", pr as (select unit_id, round(least(1e0, rank / greatest(max(rank) over (), 1e-6)), 6) centrality from r{rounds})"


@query(f"with {_pagerank_sql()} select unit_id, centrality from pr")
def pagerank(spark, sf_dir):
    """Centrality of all units in the recorded call graph."""
    return graph.pagerank(table(spark, sf_dir, "code_units").select("unit_id").where("unit_id is not null"), table(spark, sf_dir, "graph_edges"))


@query(f"with {CURRENT}, {_score_sql()}, {_pagerank_sql()} select unit_id, round(case when (select max(score) from sc) > 0 then score else 1e0 end + least(4e0, 1e0 * coalesce(centrality, 0e0)), 6) score from sc left join pr using (unit_id)")
def ranked_units(spark, sf_dir):
    """The total score of every unit: lexical, and centrality."""
    scores = context.scored_units(table(spark, sf_dir, "code_units")).select("unit_id", "score")
    return ranking.centrality_boost(scores, pagerank(spark, sf_dir))


@query(f"with {LINKS}, {PLANNED}, fl as (select distinct unit_id from pu where lower(inclusion) = 'full' and unit_id is not null) select distinct callee_id unit_id from lk where caller_id in (select unit_id from fl) and callee_id not in (select unit_id from fl)")
def dependency_pull(spark, sf_dir):
    """What the fully included units call beside themselves."""
    full = records.current_plan(table(spark, sf_dir, "planned_units")).where("lower(inclusion) = 'full' and unit_id is not null")
    return graph.dependencies(table(spark, sf_dir, "graph_edges"), full)


@query(
    f"""with {PLANNED} select session_id, count(*) items, count(*) filter (where lower(inclusion) = 'full') n_full, count(*) filter (where lower(inclusion) = 'compact') n_compact, count(*) filter (where lower(inclusion) = 'skeleton') n_skeleton, sum(greatest(coalesce(tokens, 0), 0))::bigint tokens,
    count(*) filter (where replace(lower(skeleton_reason), '_', '') = 'budgetexhausted') n_exhausted, count(*) filter (where replace(lower(skeleton_reason), '_', '') = 'lowrelevance') n_low from pu group by session_id"""
)
def tier_counts(spark, sf_dir):
    """Tiers, tokens and reasons per session."""
    return records.tier_counts(table(spark, sf_dir, "planned_units"))


@query(
    f"""with {CURRENT}, {PLANNED}, s as (select session_id, sum(coalesce(tok_full, 0)) raw, sum(greatest(coalesce(tokens, 0), 0)) used from pu join cu using (unit_id) group by session_id)
    select session_id, raw::bigint raw, used::bigint used, case when raw > 0 then round((1 - used / raw::double) * 100, 4) else 0e0 end saved_pct from s"""
)
def compression_stats(spark, sf_dir):
    """Tokens saved per session."""
    return records.compression(table(spark, sf_dir, "planned_units"), _units(spark, sf_dir, "tok_full"))


@query(
    rf"""with {CURRENT}, {PLANNED}, k as (select session_id, regexp_replace(replace(file, '\', '/'), '^(\./)+', '') || '::' || name unit_key, inclusion, recorded_at, plan_id, ord from pu join cu using (unit_id))
    select session_id, unit_key, count(*) accesses, max(recorded_at) last_at, arg_max(inclusion, (recorded_at, plan_id, ord)) last_inclusion, least(3e0, 1.5e0 * (1 + 0.25e0 * least(count(*), 3))) boost from k group by session_id, unit_key"""
)
def session_hot_set(spark, sf_dir):
    """Accesses and boost per session and unit."""
    return records.hot_set(table(spark, sf_dir, "planned_units"), _units(spark, sf_dir, "file", "name"))


@query(
    r"""with s as (select distinct repo, regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', '') path, mtime_secs, mtime_nanos, file_size, content_hash, scanned_at from file_cache where relative_path is not null),
    w as (select *, row_number() over o n, lag(mtime_secs) over o a, lag(mtime_nanos) over o b, lag(file_size) over o c, lag(content_hash) over o h from s window o as (partition by repo, path order by scanned_at nulls first, mtime_secs nulls first, mtime_nanos nulls first, file_size nulls first, content_hash nulls first))
    select repo, path, n::int scan, case when n = 1 then 'new' when coalesce(mtime_secs = a and mtime_nanos = b and file_size = c, false) then 'unchanged' when coalesce(content_hash = h, false) then 'same_content' else 'changed' end reuse from w"""
)
def scan_reuse(spark, sf_dir):
    """What each scan of a file could reuse of the one before."""
    return records.scan_reuse(table(spark, sf_dir, "file_cache"))


@query(
    rf"""select distinct repo, regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', '') path from file_cache f where relative_path is not null
    and not exists (select 1 from code_units u where u.repo = f.repo and not regexp_matches(regexp_replace(replace(u.file, '\\', '/'), '^(\\./)+', ''), '{files.IGNORED_PATH}') and regexp_replace(replace(u.file, '\', '/'), '^(\./)+', '') = regexp_replace(replace(f.relative_path, '\', '/'), '^(\./)+', ''))"""
)
def cache_purge(spark, sf_dir):
    """Cached files without units that a scan would still deliver."""
    living = table(spark, sf_dir, "code_units").where(~normal_path(F.col("file")).rlike(files.IGNORED_PATH))
    return records.purge(table(spark, sf_dir, "file_cache"), living)


@query(f"with {CURRENT} select unit_id, file, name, tok_full, array_to_string(string_split(compact_text, chr(10))[1:5], chr(10)) snippet from cu where " + " or ".join(f"contains(lower(coalesce({c}, '')), 'ledger')" for c in ("name", "signature", "kind", "file", "doc_comment")) + " or len(list_filter(coalesce(refs, []), lambda r: contains(lower(r), 'ledger'))) > 0")
def grep_units(spark, sf_dir):
    """Units that mention a ledger, with the first lines of their compact text."""
    raw = table(spark, sf_dir, "code_units")
    told = raw.select("unit_id", "file", "name", "tok_full", "ingested_at", code.mentions("ledger").alias("hit"), code.snippet(F.col("compact_text")).alias("snippet"))
    return code.current_units(told, ["file", "name", "tok_full", "hit", "snippet"]).where("hit").drop("hit")


@query(f"with {CURRENT}, c as (select name, count(*) n from cu where name is not null group by name), top as (select name from c order by n desc, name limit 1) select unit_id, repo, file, name from cu where name = (select name from top)")
def extract_units(spark, sf_dir):
    """All units of the name that occurs most."""
    units = _units(spark, sf_dir, "repo", "file", "name")
    top = units.where("name is not null").groupBy("name").count().orderBy(F.desc("count"), "name").limit(1).select("name")
    return units.join(F.broadcast(top), "name", "left_semi").select("unit_id", "repo", "file", "name")


@query("select sha256(text) digest, count(*) copies, min(doc_id) first_id from documents where text is not null and text <> '' group by 1 having count(*) > 1")
def content_copies(spark, sf_dir):
    """Texts that occur more than once, by digest."""
    docs = table(spark, sf_dir, "documents").where("text is not null and text <> ''")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def _redact_sql(x: str) -> str:
    for label, pattern, groups in redaction.RULES:
        put = (r"\1" if "1" in groups else "") + f"[REDACTED: {label}]" + (r"\2" if "2" in groups else "")
        x = f"""regexp_replace({x}, '{pattern.replace("'", "''")}', '{put}', 'g')"""
    return x


@query(f"with {CURRENT}, r as (select unit_id, full_text, {_redact_sql('full_text')} clean from cu where full_text is not null) select unit_id, md5(clean) clean_md5, ((len(string_split(clean, '[REDACTED: ')) - len(string_split(full_text, '[REDACTED: '))))::int added from r")
def redact_text(spark, sf_dir):
    """Every unit's text after the chain of redactions, as a digest, with the placeholders added."""
    raw = table(spark, sf_dir, "code_units")  # redacted where it is read, so that no text is shuffled
    told = raw.select("unit_id", "ingested_at", F.md5(redaction.redact(F.col("full_text"))).alias("clean_md5"), redaction.redactions(F.col("full_text")).alias("added"))
    return code.current_units(told, ["clean_md5", "added"]).where("clean_md5 is not null")


def _labels_sql() -> str:
    count = lambda x, label: f"len(string_split({x}, '[REDACTED: {label}]'))"
    return " union all ".join(f"select '{label}' as label, {count('clean', label)} - {count('full_text', label)} n from r" for label, _, _ in redaction.RULES)


@query(f"with {CURRENT}, r as (select full_text, {_redact_sql('full_text')} clean from cu where full_text is not null), c as ({_labels_sql()}) select label, sum(n)::bigint places, count(*) units from c where n > 0 group by label")
def redaction_labels(spark, sf_dir):
    """Places and units per kind of credential that the chain of redactions finds."""
    raw = table(spark, sf_dir, "code_units")
    told = raw.select("unit_id", "ingested_at", redaction.placeholders(F.col("full_text")).alias("found"))
    found = code.current_units(told, ["found"]).select(F.explode("found").alias("p"))
    return found.groupBy("p.label").agg(F.sum("p.n").alias("places"), F.count("*").alias("units"))


@query(
    f"""with {PLANNED}, fl as (select distinct unit_id from pu where lower(inclusion) = 'full' and unit_id is not null),
    e as (select distinct caller_id, callee_id, caller_file, caller_line from graph_edges where caller_id in (select unit_id from fl) and callee_id is not null and caller_id <> callee_id),
    k as (select *, row_number() over (partition by callee_id order by caller_id, caller_file nulls first, caller_line nulls first) n, count(*) over (partition by callee_id) calls from e)
    select callee_id, caller_id, caller_file, caller_line, calls from k where n = 1"""
)
def edge_reasons(spark, sf_dir):
    """For every unit that a fully included one calls, by which call it came in."""
    full = records.current_plan(table(spark, sf_dir, "planned_units")).where("lower(inclusion) = 'full' and unit_id is not null")
    return graph.edge_reasons(table(spark, sf_dir, "graph_edges"), full)


@query(
    rf"""with f as (select repo, regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', '') path, coalesce(max(file_size), 0) size from file_cache where relative_path is not null group by 1, 2)
    select repo, case when regexp_matches(path, '{files.IGNORED_PATH}') then 'ignored' when lower(regexp_extract(path, '[.]([\w+]+)$', 1)) in ({", ".join(f"'{x}'" for x in EXTENSIONS)}) then 'kept' else 'unread' end outcome,
    count(*) files, sum(size)::bigint bytes from f group by 1, 2"""
)
def scan_filter(spark, sf_dir):
    """Files that a scan would ignore, cannot read, or keeps, with their sizes."""
    return records.scan_filter(table(spark, sf_dir, "file_cache"))


@query(
    """with l as (select user_id, max(ts)::date as day from events where user_id is not null and ts is not null group by user_id), d as (select day, row_number() over (order by day desc) - 1 position from (select distinct day from l))
    select user_id, position::int position, round(least(3e0, 1.5e0 * greatest(0.1e0, 1 / (1 + 0.15e0 * position))), 6) boost from l join d using (day)"""
)
def recency_boost(spark, sf_dir):
    """The boost of each user by the day of the latest event."""
    return records.recency(table(spark, sf_dir, "events"))


@query("select time_bucket(interval '6 hours', ts) as start, event_type, count(*) events, round(sum(value), 4) as value from events group by 1, 2")
def event_windows(spark, sf_dir):
    """Events by six-hour window and type."""
    return watch.event_windows(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("with r as (select distinct caller_file, caller_id, callee_id, caller_line from graph_edges where caller_file is not null and callee_id is not null) select caller_file, count(distinct callee_id) callees, count(*) calls from r group by caller_file")
def file_calls(spark, sf_dir):
    """Calls and different callees per file."""
    return records.shared_callees(table(spark, sf_dir, "graph_edges"))


@query(
    f"""with {CURRENT}, {PLANNED} select session_id, plan_id, ord, to_json({{'unit_id': pu.unit_id, 'file': file, 'name': cu.name, 'kind': kind, 'start_line': start_line, 'end_line': end_line, 'inclusion': inclusion, 'tokens': tokens,
    'score_millionths': round(score * 1000000)::bigint, 'skeleton_reason': skeleton_reason}})::varchar json from pu join cu using (unit_id)"""
)
def plan_json(spark, sf_dir):
    """Each session's plan as one JSON text per included item, with its unit's place."""
    plan = records.current_plan(table(spark, sf_dir, "planned_units"))
    units = _units(spark, sf_dir, "file", "name", "kind", "start_line", "end_line")
    score = F.round(F.col("score") * 1000000).cast("long").alias("score_millionths")  # a whole number has one form in any JSON
    body = F.to_json(F.struct("unit_id", "file", "name", "kind", "start_line", "end_line", "inclusion", "tokens", score, "skeleton_reason"), {"ignoreNullFields": "false"})
    return plan.join(units, "unit_id").select("session_id", "plan_id", "ord", body.alias("json"))


@query("select distinct unit_id, repo, file, name, ceil(strlen(coalesce(full_text, '')) / 4.0)::bigint tok_full from code_units")
def watched_units(spark, sf_dir):
    """All unit files read by a stream that stops when it has caught up, as a table of token estimates."""
    path = f"{sf_dir}/code_units.parquet"
    folder, pattern = (path, "*.parquet") if os.path.isdir(path) else (sf_dir, "code_units.parquet")
    out = f"{checkpoint_dir(spark)}/watch-{os.urandom(6).hex()}"
    seen = watch.watch_units(spark, folder, pattern, spark.read.parquet(path).schema)
    seen.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").start(f"{out}/rows").awaitTermination()
    return spark.read.schema(seen.schema).parquet(f"{out}/rows").distinct()


@query(
    rf"""with {CURRENT}, k as (select session_id, regexp_replace(replace(file, '\', '/'), '^(\./)+', '') || '::' || name unit_key from planned_units pu join cu using (unit_id) where session_id is not null)
    select session_id, unit_key, count(*) accesses from k where unit_key is not null group by all"""
)
def session_memory(spark, sf_dir):
    """Every planned row as a stream into running counts per session and unit, kept as state; the last count of each key."""
    path, out = f"{sf_dir}/planned_units.parquet", f"{checkpoint_dir(spark)}/memory-{os.urandom(6).hex()}"
    folder, pattern = (path, "*.parquet") if os.path.isdir(path) else (sf_dir, "planned_units.parquet")
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", pattern).parquet(folder)
    keys = _units(spark, sf_dir, "file", "name").select("unit_id", F.concat(normal_path(F.col("file")), F.lit("::"), F.col("name")).alias("unit_key"))
    told = watch.session_memory(rows.join(keys, "unit_id").where("session_id is not null and unit_key is not null").select("session_id", "unit_key", F.col("recorded_at").cast("timestamp").alias("recorded_at")))
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{out}/rows")
    with watch.state_on_disk(spark):
        stream = told.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    stream.awaitTermination()
    seen = spark.read.schema("session_id string, unit_key string, accesses long, last_at timestamp, batch long").parquet(f"{out}/rows")
    return seen.groupBy("session_id", "unit_key").agg(F.max_by("accesses", "batch").alias("accesses"))


@query(
    f"""with {CURRENT}, c as (select distinct repo, unit_id, start_line line, unnest(refs) as name from cu)
    select distinct c.unit_id caller_id, d.unit_id callee_id, c.name callee_name, c.line from c join cu d on d.repo = c.repo and d.name = c.name and d.name not in ('', '<anonymous>') and d.unit_id <> c.unit_id"""
)
def reference_edges(spark, sf_dir):
    """The edges that all units would have by the names they refer to, had no calls been recorded."""
    units = _units(spark, sf_dir, "repo", "file", "name", "refs", "start_line")
    return graph.reference_edges(units.withColumn("calls", F.lit(None).cast("array<struct<callee:string,qualifier:string,line:int>>")))


@query(f"with {LINKS}, o as (select caller_id unit_id, list_sort(list(callee_id)) callees from lk group by 1), i as (select callee_id unit_id, list_sort(list(caller_id)) callers from lk group by 1) select unit_id, coalesce(array_to_string(callees, ','), '') callees, coalesce(array_to_string(callers, ','), '') callers from o full join i using (unit_id)")
def neighbours(spark, sf_dir):
    """The callees and the callers of every unit, as sorted lists."""
    lists = graph.neighbours(table(spark, sf_dir, "graph_edges"))
    return lists.select("unit_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("callees", "callers")])


@query(
    f"""with {_pack_sql()}, {_pagerank_sql()} select pk.grp, pk.unit_id, sc.score lexical, round(name_score, 6) name_score, round(doc_score, 6) doc_score, round(sig_score, 6) sig_score, round(body_score, 6) body_score,
    coalesce(centrality, 0e0) centrality, array_to_string({_matched_sql()}, ',') matched, coalesce(inclusion, 'left_out') tier, tokens, skeleton_reason, row_number() over (partition by pk.grp order by sc.score desc, pk.file nulls first, coalesce(start_line, 0), sc.name nulls first, pk.unit_id) place
    from pk join sc using (unit_id) left join pr using (unit_id)"""
)
def explain_units(spark, sf_dir):
    """For every unit its score parts, centrality, matched terms, tier and reason, and its place by score in its repository."""
    return context.explained(table(spark, sf_dir, "code_units"), table(spark, sf_dir, "graph_edges"), BUDGET)


@query(f"with {_pack_sql()} select grp, count(distinct file) files, count(*) units, count(*) filter (where inclusion is not null) included, sum(tokens)::bigint tokens, sum(f)::bigint raw_tokens, round(case when sum(f) > 0 then (1 - sum(tokens) / sum(f)::double) * 100 else 0e0 end, 4) saved_pct from (select pk.*, greatest(0, coalesce(tok_full, 0)) f from pk join cu using (unit_id)) group by grp")
def pack_stats(spark, sf_dir):
    """Files, units and tokens of each repository's packing, and the per cent saved."""
    raw = table(spark, sf_dir, "code_units")
    full = _units(spark, sf_dir, "tok_full").select("unit_id", F.greatest(F.lit(0), F.coalesce("tok_full", F.lit(0))).alias("f"))
    files = _units(spark, sf_dir, "file")
    plan = context.packed(raw, BUDGET).join(full, "unit_id").join(files, "unit_id")
    saved = F.when(F.sum("f") > 0, (1 - F.sum("tokens") / F.sum("f")) * 100).otherwise(0.0)
    return plan.groupBy("grp").agg(F.count_distinct("file").alias("files"), F.count("*").alias("units"), F.count("inclusion").alias("included"), F.sum("tokens").alias("tokens"), F.sum("f").alias("raw_tokens"), F.round(saved, 4).alias("saved_pct"))



@query(
    rf"""with {CURRENT}, {PLANNED}, {_score_sql()}, hk as (select regexp_replace(replace(file, '\', '/'), '^(\./)+', '') || '::' || name unit_key, least(3e0, 1.5e0 * (1 + 0.25e0 * least(count(*), 3))) boost from pu join cu using (unit_id) where session_id = 'sess-nightly-sweep' group by 1)
    select unit_id, round(score + coalesce(boost, 0e0), 6) score from (select *, regexp_replace(replace(file, '\', '/'), '^(\./)+', '') || '::' || name unit_key from sc) left join hk using (unit_key)"""
)
def session_scores(spark, sf_dir):
    """The scores of all units after the boost of one session's hot set, the greatest session's."""
    hot = records.hot_set(table(spark, sf_dir, "planned_units").where("session_id = 'sess-nightly-sweep'"), _units(spark, sf_dir, "file", "name"))
    scores = context.scored_units(table(spark, sf_dir, "code_units")).select("unit_id", F.concat(normal_path(F.col("file")), F.lit("::"), F.col("name")).alias("unit_key"), "score")
    return ranking.add_boost(scores, hot, "unit_key").select("unit_id", "score")


RECENT = r"""tc as (select distinct repo, regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', '') path, mtime_secs from file_cache where relative_path is not null and mtime_secs is not null and repo is not null),
    ps as (select repo, mtime_secs, row_number() over (partition by repo order by mtime_secs desc) - 1 position from (select distinct repo, mtime_secs from tc)),
    fr as (select repo, path, max(greatest(0.1e0, 1 / (1 + 0.15e0 * position))) recency from tc join ps using (repo, mtime_secs) where position < 30 group by all)"""


@query(f"with {RECENT} select repo, path, round(recency, 6) recency from fr")
def file_recency(spark, sf_dir):
    """How recent each file among the last thirty changes of its repository is."""
    return records.file_recency(table(spark, sf_dir, "file_cache")).withColumn("recency", F.round("recency", 6))


@query(
    rf"""with {CURRENT}, {_score_sql()}, {RECENT}, up as (select unit_id, repo, regexp_replace(replace(file, '\', '/'), '^(\./)+', '') path from cu where file is not null),
    mt as (select unit_id, max(recency) filter (where fr.path = up.path) exact, max(recency) ended from up join fr on fr.repo = up.repo and (fr.path = up.path or ends_with(up.path, '/' || fr.path)) group by unit_id)
    select unit_id, round(score + case when ended is null then 0e0 else round(least(3e0, 1.5e0 * coalesce(exact, ended)), 6) end, 6) score from sc left join mt using (unit_id)"""
)
def recent_scores(spark, sf_dir):
    """The scores of all units after the boost of recently changed files, found by path or by its end."""
    boosts = records.recency_of_units(_units(spark, sf_dir, "repo", "file"), records.file_recency(table(spark, sf_dir, "file_cache")))
    return ranking.add_boost(context.scored_units(table(spark, sf_dir, "code_units")).select("unit_id", "score"), boosts, "unit_id")


@query(
    r"""with e as (select distinct repo, sha256(concat_ws('|', regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', ''), coalesce(mtime_secs::varchar, ''), coalesce(mtime_nanos::varchar, ''), coalesce(file_size::varchar, ''), coalesce(content_hash, ''))) d from file_cache where repo is not null and relative_path is not null),
    b as (select repo, left(d, 2) k, count(*) n, sha256(string_agg(d, '' order by d)) part from e group by all) select repo, sum(n)::bigint entries, sha256(string_agg(k || part, '' order by k || part)) checksum from b group by repo"""
)
def cache_checksum(spark, sf_dir):
    """A digest of each repository's manifest."""
    return records.cache_checksum(table(spark, sf_dir, "file_cache"))


@query(
    r"""with l as (select repo, doc_id, case when doc_kind = 'readme' then trim(regexp_replace(split_part(regexp_replace(text, '^\s+', ''), chr(10), 1), '^#+ *', ''), ' ') end line from documents where repo is not null),
    f as (select repo, arg_min(line, doc_id) filter (where strlen(line) between 1 and 120) line from l group by repo) select repo, coalesce(line, repo) intent from f"""
)
def weak_intent(spark, sf_dir):
    """What each repository says of itself where no question is asked."""
    return records.weak_intent(table(spark, sf_dir, "documents"))


GLOBS = ["*_test.*", "/gen/", "deps/**", "*.g.*", "!lib/tmp", "codegen/"]


@query(
    rf"""with f as (select repo, regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', '') path from file_cache where relative_path is not null)
    select repo, path, bool_or(regexp_matches(path, '{"|".join(files.glob_regex(g) for g in GLOBS)}')) excluded from f group by all"""
)
def scan_globs(spark, sf_dir):
    """Which cached files a few custom globs exclude."""
    paths = table(spark, sf_dir, "file_cache").select("repo", normal_path(F.col("relative_path")).alias("path")).where("path is not null").distinct()
    return paths.withColumn("excluded", files.by_globs(F.col("path"), GLOBS))


@query(
    rf"""with u as (select repo, regexp_replace(replace(file, '\', '/'), '^(\./)+', '') path, encode(full_text) content, full_text t from code_units where file is not null),
    o as (select distinct repo, path, case when regexp_matches(path, '{files.IGNORED_PATH}') then 'ignored' when lower(regexp_extract(path, '[.]([\w+]+)$', 1)) in ({", ".join(f"'{x}'" for x in files.BINARY)}) or starts_with(coalesce(t, ''), 'GGUF') or contains(coalesce(t, ''), chr(0)) then 'binary'
      when lower(regexp_extract(path, '[.]([\w+]+)$', 1)) in ({", ".join(f"'{x}'" for x in EXTENSIONS)}) then 'kept' else 'unread' end outcome from u),
    s as (select repo, path, row_number() over (partition by repo order by path) k from (select distinct repo, path from o where outcome in ('ignored', 'binary')))
    select repo, count(*) filter (where outcome = 'ignored') as ignored, count(*) filter (where outcome = 'binary') as "binary", count(*) filter (where outcome = 'unread') as unread, count(*) filter (where outcome = 'kept') as kept, 0::bigint binary_bytes,
    coalesce((select string_agg(path, ',' order by path) from s where k <= 5 and s.repo = o.repo), '') samples from o group by repo"""
)
def scan_stats(spark, sf_dir):
    """Files of the recorded units that a scan would pass over, cannot read, or keeps, with the first ones passed over."""
    units = table(spark, sf_dir, "code_units").select("repo", normal_path(F.col("file")).alias("path"), F.encode("full_text", "UTF-8").alias("content"))
    return files.scan_statistics(units)


@query(
    rf"""with f as (select distinct repo, regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', '') path from file_cache where relative_path is not null), l(ext, language) as (values {", ".join(f"('{k}', '{v}')" for k, v in EXTENSIONS.items())})
    select language, string_agg(distinct ext, ',' order by ext) endings, count(*) files from f join l on lower(regexp_extract(path, '[.]([\w+]+)$', 1)) = ext group by language"""
)
def languages(spark, sf_dir):
    """The languages of the cached files, with the endings met and the number of files."""
    paths = table(spark, sf_dir, "file_cache").select("repo", normal_path(F.col("relative_path")).alias("path")).where("path is not null").distinct()
    told = paths.select(files.language_of(F.col("path")).alias("language"), files.extension(F.col("path")).alias("ext")).where("language is not null")
    return told.groupBy("language").agg(F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("endings"), F.count("*").alias("files"))


@query(
    f"""with {CURRENT}, b as (select repo, file, count(*) n from cu where file is not null and repo is not null group by all), t as (select repo, file from (select *, row_number() over (partition by repo order by n desc, file) k from b) where k = 1)
    select repo, file, unit_id, kind, name, signature, start_line, end_line, tok_full, tok_compact, tok_skeleton, row_number() over (partition by repo, file order by start_line nulls first, unit_id)::int place from cu join t using (repo, file)"""
)
def file_outline(spark, sf_dir):
    """The units of each repository's fullest file, in their order."""
    units = _units(spark, sf_dir, "repo", "file", "kind", "name", "signature", "start_line", "end_line", "tok_full", "tok_compact", "tok_skeleton").where("file is not null and repo is not null")
    first = units.groupBy("repo", "file").count().groupBy("repo").agg(F.min(F.struct(-F.col("count"), F.col("file").alias("file"))).alias("best")).select("repo", "best.file")
    return units.join(first, ["repo", "file"], "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("repo", "file").orderBy("start_line", "unit_id")))


@query()
def extracted_units(spark, sf_dir):
    """Units found anew in every file, put together from its outermost recorded units, with the recorded unit at their place."""
    units = _units(spark, sf_dir, "repo", "file", "name", "kind", "start_line", "end_line", "doc_comment", "full_text")
    found = extract.extract(extract.assembled(units))
    recorded = units.groupBy("repo", "file", "name", "start_line").agg(F.min("unit_id").alias("recorded_id"), F.max("end_line").alias("recorded_end"))
    met = found.join(recorded, ["repo", "file", "name", "start_line"], "left")
    return met.select("repo", "file", "kind", "name", "start_line", "end_line", "tok_full", "tok_compact", "tok_skeleton", F.size("calls").alias("n_calls"), F.size("refs").alias("n_refs"), F.length("doc_comment").alias("doc_chars"), "recorded_id", "recorded_end")


__all__ = ["QUERIES", "SQL"]
