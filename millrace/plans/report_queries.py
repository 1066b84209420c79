"""Queries that sum up runs: variants, tables in Markdown, queues, adapters; and the small text parsers of logs and tools."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import patches, text
from millrace.operators import evaluation, reports
from millrace.operators.distinct import rows_once
from millrace.plans.dataset_queries import ENTRIES, _entries
from millrace.session import checkpointed, shared_folder
from millrace.sources import store
from millrace.sources.tables import table

#: Running tasks at most; what begins, ends and asks for a task in the events.
CAPACITY, STARTS, ENDS, ASKS = 2, ("click",), ("view",), ("signup", "purchase")


def queue_states(spark, sf_dir):
    """The queue of every user after each event: a click starts a task, a view ends one, a signup or a purchase asks for one,
    which is refused while as many run as may."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").distinct()
    op = F.when(F.col("event_type").isin(*STARTS), "started").when(F.col("event_type").isin(*ENDS), "finished").when(F.col("event_type").isin(*ASKS), "queued")
    rows = events.select("event_id", F.col("user_id").alias("key"), "ts", op.alias("op")).where("op is not null")
    return reports.queue_states(rows, "key", ["ts", "event_id"], CAPACITY).select("event_id", "running", "queued", "completed", "rejected", "utilisation")


QUEUE = """WITH o AS (SELECT event_id, user_id AS k, ts, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS d, event_type IN ('signup', 'purchase') AS asks FROM (SELECT DISTINCT event_id, ts, user_id, event_type FROM events)
  WHERE event_type IN ('click', 'view', 'signup', 'purchase')),
s AS (SELECT *, sum(d) OVER w AS s FROM o WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)),
r AS (SELECT *, s - least(0, min(s) OVER w) AS running FROM s WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)),
b AS (SELECT *, coalesce(lag(running) OVER w, 0) AS was FROM r WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)),
q AS (SELECT *, CASE WHEN asks AND was < 2 THEN 1 WHEN d = 1 THEN -1 ELSE 0 END AS e, asks AND was >= 2 AS no FROM b),
t AS (SELECT *, sum(e) OVER w AS t FROM q WINDOW w AS (PARTITION BY k ORDER BY ts, event_id))
SELECT event_id, running::BIGINT AS running, (t - least(0, min(t) OVER w))::BIGINT AS queued, count(*) FILTER (d = -1) OVER w AS completed, count(*) FILTER (no) OVER w AS rejected, round(running / 2 * 100, 1) AS utilisation
FROM t WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)"""


def _runs(spark, sf_dir):
    """Attempts as results of variants: the number of the attempt is the variant."""
    rows = _entries(spark, sf_dir, "attempt", "resolved", "patch", "token_cost", "failure_category", "localised_files")
    found = F.size(F.array_intersect(F.slice(F.coalesce("localised_files", F.array().cast("array<string>")), 1, 5), text.diff_files(F.col("patch"))))
    gold = F.size(text.diff_files(F.col("patch")))
    return rows.select(
        F.coalesce(F.concat(F.lit("attempt "), F.col("attempt").cast("string")), F.lit("?")).alias("variant"), F.coalesce("resolved", F.lit(False)).alias("resolved"),
        (F.trim(F.coalesce("patch", F.lit(""))) != "").alias("patched"), F.coalesce("attempt", F.lit(0)).alias("attempts"), evaluation.map_total(F.col("token_cost")).alias("tokens"),
        F.when(gold > 0, found / gold).otherwise(0.0).alias("recall"), F.coalesce(F.when(F.trim("failure_category") != "", F.lower(F.trim("failure_category"))), F.lit("unknown")).alias("category"),
    )


GOLD = r"list_distinct(regexp_extract_all(coalesce(patch, ''), '(?m)^(?:\+\+\+|---)[ \t]+[ab]/([^\s]+)', 1))"
RUNS = f"""u AS (SELECT coalesce('attempt ' || attempt, '?') AS variant, coalesce(resolved, false) AS resolved, trim(coalesce(patch, '')) <> '' AS patched, coalesce(attempt, 0) AS attempts,
  coalesce(list_sum(map_values(coalesce(token_cost, MAP {{}}))), 0) AS tokens, CASE WHEN len({GOLD}) > 0 THEN len(list_intersect({GOLD}, coalesce(localised_files, [])[1:5])) / len({GOLD}) ELSE 0 END AS recall,
  coalesce(lower(nullif(trim(failure_category), '')), 'unknown') AS category FROM ({ENTRIES}))"""


def variant_summary(spark, sf_dir):
    return reports.variant_summary(_runs(spark, sf_dir))


VARIANT = """v AS (SELECT variant, count(*) AS n, count(*) FILTER (patched) AS patched, count(*) FILTER (resolved) AS resolved, round(avg(resolved::INT) * 100, 2) AS rate, round(avg(attempts), 2) AS avg_attempts,
  round(avg(tokens)) AS avg_tokens, round(avg(recall), 6) AS recall FROM u GROUP BY variant)"""
VARIANT_SUMMARY = f"WITH {RUNS}, {VARIANT} SELECT * FROM v"


def ablation_table(spark, sf_dir):
    """The variants as a table in Markdown, one line each, from reports that were written and read again."""
    path = f"{shared_folder(spark)}/reports-{uuid.uuid4()}"
    store.save_reports(reports.variant_summary(_runs(spark, sf_dir)), path, "variant")
    schema = "variant string, n bigint, patched bigint, resolved bigint, rate double, avg_attempts double, avg_tokens double, recall double"
    return reports.markdown_table(store.load_reports(spark, path, schema))


ABLATION = f"""WITH {RUNS}, {VARIANT}, l AS (SELECT row_number() OVER (ORDER BY variant) AS place, '| ' || variant || ' | ' || printf('%.2f%%', rate) || ' | ' || printf('%.3f', recall) || ' | ' || printf('%.2f', avg_attempts) || ' | ' || printf('%d', avg_tokens::BIGINT) || ' | ' || n || ' |' AS line FROM v)
SELECT * FROM l UNION ALL SELECT -1, '| Variant | Resolved | Recall@5 | Attempts | Tokens | N |' UNION ALL SELECT 0, '|---|---|---|---|---|---|'"""


def category_breakdown(spark, sf_dir):
    """How many attempts of each variant have which category, the commonest first."""
    counts = _runs(spark, sf_dir).groupBy("variant", "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("n"), "category")).cast("bigint"))


BREAKDOWN = f"WITH {RUNS} SELECT variant, category, count(*) AS n, row_number() OVER (PARTITION BY variant ORDER BY count(*) DESC, category) AS place FROM u GROUP BY variant, category"


def log_statistics(spark, sf_dir):
    """One row over the whole log: entries, resolved ones and their rate, the mean attempt number, instances, tokens, and the
    entries of each state of the running totals."""
    rows = _entries(spark, sf_dir, "instance_id", "attempt", "resolved", "token_cost")
    good = F.coalesce("resolved", F.lit(False))
    total = F.coalesce(F.col("token_cost")["total_tokens"], F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("resolved"), F.round(F.coalesce(F.avg(good.cast("int")), F.lit(0.0)), 6).alias("resolved_rate"), F.round(F.avg("attempt"), 6).alias("avg_attempts"),
        F.count_distinct("instance_id").alias("unique_instances"), F.coalesce(F.sum(total), F.lit(0)).cast("bigint").alias("total_tokens"), F.round(F.avg(total), 4).alias("avg_tokens"),
    )


LOG_STATISTICS = f"""SELECT count(*) AS total, count(*) FILTER (resolved) AS resolved, round(avg(coalesce(resolved, false)::INT), 6) AS resolved_rate, round(avg(attempt), 6) AS avg_attempts, count(DISTINCT instance_id) AS unique_instances,
  sum(coalesce(token_cost['total_tokens'], 0))::BIGINT AS total_tokens, round(avg(coalesce(token_cost['total_tokens'], 0)), 4) AS avg_tokens FROM ({ENTRIES})"""


def answer_formats(spark, sf_dir):
    """How well the answers of each source keep to the form of a find-and-replace block, from 0 to 1 in quarters, against
    those of the gold patches, and what that says."""
    rows = rows_once(table(spark, sf_dir, "fine_tuning", "example_id", "source", "messages"), "example_id")
    answers = rows.select(F.coalesce("source", F.lit("?")).alias("source"), F.explode("messages").alias("m")).where("lower(trim(m.role)) in ('assistant', 'gpt') and m.content is not null")
    scored = answers.select("source", reports.format_score(F.col("m.content"), reports.BLOCK_MARKS).alias("score"), F.regexp_count("m.content", F.lit(reports.BLOCK_MARKS[0])).alias("blocks"))
    per = scored.groupBy("source").agg(F.count(F.lit(1)).alias("answers"), F.sum("blocks").cast("bigint").alias("blocks"), F.round(F.avg("score"), 6).alias("score"))
    return reports.against(per, "source", "gold_patch", "score")


SCORES = r"""m AS (SELECT coalesce(source, '?') AS source, unnest(messages) AS x FROM (SELECT DISTINCT example_id, source, messages FROM fine_tuning)),
a AS (SELECT source, count(*) AS answers, sum(len(regexp_extract_all(x.content, '<<\s*FIND')))::BIGINT AS blocks, round(avg(0.25::DOUBLE * (regexp_matches(x.content, '<<\s*FIND')::INT + regexp_matches(x.content, '==\s*WITH')::INT
  + regexp_matches(x.content, 'END\s*>>')::INT + (NOT contains(x.content, '```'))::INT)), 6) AS score FROM m WHERE lower(trim(x.role)) IN ('assistant', 'gpt') AND x.content IS NOT NULL GROUP BY source)"""
ANSWER_FORMATS = f"""WITH {SCORES}, d AS (SELECT a.*, round(a.score - b.score, 6) AS delta FROM a, (SELECT score FROM a WHERE source = 'gold_patch') b)
SELECT *, CASE WHEN delta > 0.05 THEN 'improved' WHEN delta > 0 THEN 'marginal' ELSE 'none' END AS verdict FROM d"""


def answer_blocks(spark, sf_dir):
    """The first block of every answer: what is to be found and what replaces it, by digest."""
    rows = rows_once(table(spark, sf_dir, "fine_tuning", "example_id", "messages"), "example_id")
    answers = rows.select("example_id", F.posexplode("messages").alias("place", "m")).where("lower(trim(m.role)) in ('assistant', 'gpt')")
    find, new = (F.regexp_extract("m.content", r"(?s)<<FIND\n(.*?)\n==WITH\n(.*?)END>>", k) for k in (1, 2))
    return answers.where(F.col("m.content").rlike(r"(?s)<<FIND\n.*?\n==WITH\n.*?END>>")).select("example_id", F.col("place").cast("bigint").alias("place"), F.sha2(find, 256).alias("find"), F.sha2(new, 256).alias("new"))


ANSWER_BLOCKS = r"""WITH m AS (SELECT example_id, unnest(messages) AS x, generate_subscripts(messages, 1) - 1 AS place FROM (SELECT DISTINCT example_id, messages FROM fine_tuning)),
b AS (SELECT example_id, place, regexp_extract(x.content, '(?s)<<FIND\n(.*?)\n==WITH\n(.*?)END>>', ['f', 'n']) AS r FROM m WHERE lower(trim(x.role)) IN ('assistant', 'gpt') AND regexp_matches(x.content, '(?s)<<FIND\n.*?\n==WITH\n.*?END>>'))
SELECT example_id, place, sha256(r.f) AS find, sha256(r.n) AS new FROM b"""


def replaced_functions(spark, sf_dir):
    """Every Python file with the lines of its first recorded function, found again without their indents, replaced by a
    remark: how the block was found, and the digest of the result."""
    files = rows_once(table(spark, sf_dir, "source_files", "file_id", "file_path", "source"), "file_id").where("source is not null and lower(file_path) like '%.py'")
    known = rows_once(table(spark, sf_dir, "file_symbols", "file_id", "functions"), "file_id").where("size(functions) > 0").select("file_id", F.col("functions")[0].alias("f"))
    both = files.join(known, "file_id").where("f.start_line > 0 and f.end_line >= f.start_line").groupBy("file_id").agg(F.max(F.struct("source", "f.start_line", "f.end_line")).alias("x"))
    block = F.slice(F.split("x.source", "\n"), F.col("x.start_line"), F.col("x.end_line") - F.col("x.start_line") + 1)
    edits = both.select("file_id", F.col("x.source").alias("content"), F.array_join(F.transform(block, lambda x: F.trim(x)), "\n").alias("search"), F.lit("# moved").alias("replacement"))
    return patches.replaced_blocks(edits, "file_id").select("file_id", "how", F.sha2("content", 256).alias("digest"))


REPLACED = r"""WITH s AS (SELECT DISTINCT file_id, source FROM source_files WHERE source IS NOT NULL AND lower(file_path) LIKE '%.py'), k AS (SELECT DISTINCT file_id, functions[1] AS f FROM file_symbols WHERE len(functions) > 0),
x AS (SELECT file_id, max((source, f.start_line, f.end_line)) AS x FROM s JOIN k USING (file_id) WHERE f.start_line > 0 AND f.end_line >= f.start_line GROUP BY file_id),
e AS (SELECT file_id, x[1] AS content, string_split(x[1], chr(10)) AS raw, [trim(l, ' ') for l in string_split(x[1], chr(10))[x[2]:x[3]]] AS ls FROM x),
f AS (SELECT *, array_to_string(ls, chr(10)) AS search, regexp_replace(array_to_string(ls, chr(10)), '^\n+|\n+$', '', 'g') AS core, [trim(l, ' ') for l in raw] AS have FROM e),
g AS (SELECT *, string_split(core, chr(10)) AS want, CASE WHEN trim(search, ' ') = '' THEN 'blank' WHEN strpos(content, search) > 0 THEN 'exact' END AS how FROM f),
c AS (SELECT file_id, have, want, unnest(range(0, len(have) - len(want) + 1)) AS start FROM g WHERE how IS NULL AND len(want) <= len(have)),
d AS (SELECT *, len([1 for i in range(1, len(want) + 1) if want[i] = have[start + i] AND want[i] <> '']) > 0 AS anchored FROM c),
p AS (SELECT file_id, start, round(list_sum([1 - levenshtein(have[start + i], want[i]) / greatest(length(have[start + i]), length(want[i]), 1) for i in range(1, len(want) + 1)]) / len(want), 6) AS likeness
  FROM d WHERE anchored OR file_id NOT IN (SELECT file_id FROM d WHERE anchored)),
b AS (SELECT file_id, arg_max(start, (likeness, -start)) AS start, max(likeness) AS likeness FROM p GROUP BY file_id),
o AS (SELECT g.*, CASE WHEN likeness > 0.85 THEN start END AS start FROM g LEFT JOIN b USING (file_id))
SELECT file_id, coalesce(how, CASE WHEN start IS NOT NULL THEN 'alike' ELSE 'missing' END) AS how, sha256(CASE WHEN how = 'blank' THEN content
  WHEN how = 'exact' THEN content[1:strpos(content, search) - 1] || '# moved' || content[strpos(content, search) + length(search):]
  WHEN start IS NOT NULL THEN array_to_string(raw[1:start] || [regexp_extract(raw[start + 1], '^([ \t]*)', 1) || '# moved'] || raw[start + len(want) + 1:], chr(10)) ELSE '' END) AS digest FROM o"""


def log_excerpts(spark, sf_dir):
    """What each log comes down to: the lines around its first failure, and its summary, by digest."""
    rows = _entries(spark, sf_dir, "test_stdout").where("test_stdout <> ''")
    log = F.col("test_stdout")
    return rows.select("entry_id", F.sha2(text.error_context(log), 256).alias("context"), F.sha2(text.log_summary(log), 256).alias("summary"))


LOG_EXCERPTS = rf"""WITH b AS (SELECT entry_id, test_stdout AS t, string_split(regexp_replace(test_stdout, '\n$', ''), chr(10)) AS l FROM ({ENTRIES}) WHERE test_stdout <> ''),
c AS (SELECT *, list_position([contains(x, 'FAILED') OR contains(x, 'ERROR') OR contains(lower(x), 'assert') for x in l], true) AS first,
  coalesce(list_position([starts_with(x, '_ _ _ ') OR contains(x, 'FAILURES') for x in l], true), 0) AS begin FROM b),
d AS (SELECT *, flatten([CASE WHEN starts_with(x, 'FAILED') OR contains(x, 'Error') THEN [x] ELSE [] END || CASE WHEN begin > 0 AND i >= begin THEN [x] ELSE [] END for x, i in l])[1:40] AS failures,
  list_filter(l, lambda x: regexp_matches(x, '\d+ (passed|failed|error)')) AS counts FROM c),
e AS (SELECT *, array_to_string(CASE WHEN len(failures) > 0 THEN counts || ['---'] || failures ELSE counts END, chr(10)) AS s FROM d)
SELECT entry_id, sha256(array_to_string(CASE WHEN first > 0 THEN l[greatest(first - 2, 1):first + 19] ELSE l[greatest(len(l) - 19, 1):] END, chr(10))) AS context, sha256(CASE WHEN s = '' THEN t[1:1000] ELSE s END) AS summary FROM e"""


def test_commands(spark, sf_dir):
    """Wanted tests as their runners are called with them: one bracketed name makes a whole entry's names Django's; modules are
    those of the first three."""
    rows = _entries(spark, sf_dir, "fail_to_pass_results").where("size(fail_to_pass_results) > 0")
    names = F.array_sort(F.map_keys("fail_to_pass_results"))
    style = F.exists(names, lambda t: t.rlike(r"^test_\w+\s+\(\w[\w.]+\)$"))
    targets = F.transform(F.filter(names, lambda t: ~F.contains(t, F.lit(" ")) | F.contains(t, F.lit("::")) | t.rlike(r"^test_\w+\s+\([\w.]+\)$")), text.test_target)
    return rows.select(
        "entry_id", style.alias("django"), F.sha2(F.array_join(F.when(style, targets).otherwise(names), "\n"), 256).alias("targets"), F.array_join(F.transform(F.slice(names, 1, 3), text.test_module), " ").alias("modules")
    )


TEST_COMMANDS = rf"""WITH n AS (SELECT entry_id, list_sort(map_keys(fail_to_pass_results)) AS l FROM ({ENTRIES}) WHERE cardinality(fail_to_pass_results) > 0),
s AS (SELECT *, len(list_filter(l, lambda t: regexp_matches(t, '^test_\w+\s+\(\w[\w.]+\)$'))) > 0 AS django FROM n),
i AS (SELECT *, [CASE WHEN contains(t, ' (') THEN replace(string_split(t, ' (')[2], ')', '') ELSE t END for t in l[1:3]] AS nm FROM s),
p AS (SELECT *, [string_split(string_split(t, '::')[1], '.') for t in nm] AS heads FROM i)
SELECT entry_id, django, sha256(array_to_string(CASE WHEN django THEN [regexp_replace(t, '^(test_\w+)\s+\(([\w.]+)\)$', '\2.\1') for t in l if NOT contains(t, ' ') OR contains(t, '::') OR regexp_matches(t, '^test_\w+\s+\([\w.]+\)$')] ELSE l END, chr(10))) AS targets,
  array_to_string([CASE WHEN coalesce(list_position([starts_with(q, 'test_') for q in h], true), 0) > 0 THEN array_to_string(h[1:list_position([starts_with(q, 'test_') for q in h], true)], '.') ELSE nm[k] END for h, k in heads], ' ') AS modules FROM p"""


def tool_prompts(spark, sf_dir):
    """Every tool result as a prompt shows it, by digest."""
    rows = rows_once(table(spark, sf_dir, "tool_results", "result_id", "tool_name", "success", "output", "error"), "result_id")
    return rows.select("result_id", F.sha2(text.tool_prompt(F.col("tool_name"), F.coalesce("success", F.lit(False)), F.col("output"), F.col("error")), 256).alias("digest"))


TOOL_PROMPTS = """SELECT result_id, sha256('[TOOL: ' || coalesce(tool_name, '') || ' | ' || CASE WHEN success THEN 'SUCCESS' ELSE 'ERROR' END || ']' || CASE WHEN output <> '' THEN chr(10) || output[1:3000] ELSE '' END
  || CASE WHEN error <> '' THEN chr(10) || 'ERROR: ' || error[1:500] ELSE '' END) AS digest FROM (SELECT DISTINCT result_id, tool_name, success, output, error FROM tool_results)"""


def file_views(spark, sf_dir):
    """Every source as a reading tool shows its first 300 lines, by digest."""
    files = rows_once(table(spark, sf_dir, "source_files", "file_id", "source"), "file_id").where("source is not null")
    return files.select("file_id", F.sha2(text.view(F.col("source")), 256).alias("view"))


VIEWS = r"""WITH l AS (SELECT file_id, source, string_split(regexp_replace(source, '\n$', ''), chr(10)) AS l FROM (SELECT DISTINCT file_id, source FROM source_files WHERE source IS NOT NULL))
SELECT file_id, sha256(CASE WHEN source = '' THEN '' ELSE array_to_string([printf('%4d | %s', i, x) for x, i in l[1:300]], chr(10)) || CASE WHEN len(l) > 300 THEN chr(10) || '... [' || (len(l) - 300) || ' more lines truncated]' ELSE '' END END) AS view FROM l"""


def context_views(spark, sf_dir):
    """Every source as a prompt shows it, by digest."""
    files = rows_once(table(spark, sf_dir, "source_files", "file_id", "source"), "file_id").where("source is not null")
    return files.select("file_id", F.sha2(text.context_view(F.col("source")), 256).alias("context"))


def cached_files(spark, sf_dir):
    """Whether the kept symbols of each file are those of its source: hit, stale, miss, or gone."""
    files = table(spark, sf_dir, "source_files", "file_id", "source").where("source is not null").select("file_id", F.sha2("source", 256).alias("digest"))
    kept = table(spark, sf_dir, "file_symbols", "file_id", "file_hash").select("file_id", F.col("file_hash").alias("digest"))
    return store.cache_state(files, kept, "file_id", "digest")


CACHED = """WITH n AS (SELECT DISTINCT file_id, sha256(source) AS d FROM source_files WHERE source IS NOT NULL AND file_id IS NOT NULL), k AS (SELECT DISTINCT file_id, file_hash AS d FROM file_symbols WHERE file_id IS NOT NULL)
SELECT coalesce(n.file_id, k.file_id) AS file_id, CASE WHEN bool_or(n.d IS NOT DISTINCT FROM k.d AND k.file_id IS NOT NULL AND n.file_id IS NOT NULL) THEN 'hit' WHEN bool_or(k.file_id IS NULL) THEN 'miss' WHEN bool_or(n.file_id IS NULL) THEN 'gone' ELSE 'stale' END AS state
FROM n FULL JOIN k ON n.file_id = k.file_id GROUP BY 1"""


def file_listing(spark, sf_dir):
    """The first 50 Python files of every repository as written, and how many more there are."""
    files = table(spark, sf_dir, "source_files", "repo", "file_path").where("lower(file_path) like '%.py'").distinct()
    return reports.listings(files, "repo", "file_path", 50)


LISTING = """WITH f AS (SELECT DISTINCT repo, file_path FROM source_files WHERE lower(file_path) LIKE '%.py'), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_path) AS r FROM f)
SELECT repo, count(*) AS files, string_agg(file_path, chr(10) ORDER BY file_path) FILTER (r <= 50) || CASE WHEN count(*) > 50 THEN chr(10) || '... and ' || (count(*) - 50) || ' more' ELSE '' END AS listing FROM r GROUP BY repo"""


def selected_instances(spark, sf_dir):
    """Of the entries with tool results the first 100 by entry_id after the first 20: ids first, then offset and limit; the
    test lists as JSON, and names in the forms of caches, organisations and projects."""
    rows = _entries(spark, sf_dir, "instance_id", "repo", "fail_to_pass_results")
    ids = table(spark, sf_dir, "tool_results", "entry_id")
    chosen = reports.selected(rows, "entry_id", ids, 100, 20)
    names = F.array_sort(F.coalesce(F.map_keys("fail_to_pass_results"), F.array().cast("array<string>")))
    as_json = F.to_json(names)
    return chosen.select("entry_id", F.size(text.json_list(as_json)).cast("bigint").alias("tests"), F.replace("repo", F.lit("/"), F.lit("__")).alias("repo_key"), F.split_part("repo", F.lit("/"), F.lit(1)).alias("organisation"), text.safe_key(F.col("instance_id")).alias("cache_key"))


SELECTED = f"""SELECT entry_id, coalesce(cardinality(fail_to_pass_results), 0)::BIGINT AS tests, replace(repo, '/', '__') AS repo_key, split_part(repo, '/', 1) AS organisation, translate(instance_id, '/:\\ ', '____') AS cache_key
FROM ({ENTRIES}) WHERE entry_id IN (SELECT entry_id FROM tool_results) ORDER BY entry_id LIMIT 100 OFFSET 20"""


def open_instances(spark, sf_dir):
    """Instances that no attempt resolved yet, with their attempts: what a resumed run has left."""
    rows = _entries(spark, sf_dir, "instance_id", "resolved").where("trim(instance_id) <> ''")
    done = rows.where("resolved").select("instance_id").distinct()
    return rows.join(done, "instance_id", "left_anti").groupBy("instance_id").agg(F.count(F.lit(1)).alias("attempts"))


OPEN = f"SELECT instance_id, count(*) AS attempts FROM ({ENTRIES}) WHERE trim(instance_id) <> '' AND instance_id NOT IN (SELECT instance_id FROM trajectories WHERE resolved AND instance_id IS NOT NULL) GROUP BY instance_id"


def logged_again(spark, sf_dir):
    """The entries appended to a log of JSON lines, with broken ones among them, and read back: rows and a sum of digests."""
    from millrace.sources import jsonl

    path = f"{shared_folder(spark)}/log-{uuid.uuid4()}"
    rows = checkpointed(_entries(spark, sf_dir, "instance_id", "attempt", "patch", "localised_files"))
    jsonl.append_jsonl(rows, path)
    rows.select(F.concat(F.lit("{broken "), F.col("entry_id").cast("string")).alias("value")).write.mode("append").text(path)
    found = jsonl.read_jsonl(spark, path, "entry_id bigint, instance_id string, attempt int, patch string, localised_files array<string>", required=("entry_id",), known_only=True)
    return found.select("entry_id", F.sha2(F.concat_ws("|", "instance_id", F.col("attempt").cast("string"), "patch", F.array_join("localised_files", ",")), 256).alias("digest"))


LOGGED = f"""SELECT entry_id, sha256(concat_ws('|', instance_id, attempt, patch, array_to_string(localised_files, ','))) AS digest FROM ({ENTRIES})"""

def imported_roots(spark, sf_dir):
    """The top-level modules that files import, relative imports without a name left out: files and distinct repositories."""
    files = rows_once(table(spark, sf_dir, "file_symbols", "file_id", "repo", "imports"), "file_id")
    roots = F.array_distinct(F.filter(F.transform("imports", lambda i: F.split(i["module"], r"\.")[0]), lambda x: x != ""))
    return files.select("file_id", "repo", F.explode(roots).alias("root")).groupBy("root").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("repo").alias("repositories"))


IMPORTED_ROOTS = """WITH r AS (SELECT file_id, repo, unnest(list_distinct(list_filter([split_part(i.module, '.', 1) for i in imports], lambda x: x <> ''))) AS root FROM (SELECT DISTINCT file_id, repo, imports FROM file_symbols))
SELECT root, count(*) AS files, count(DISTINCT repo) AS repositories FROM r GROUP BY root"""


def test_sources(spark, sf_dir):
    """The files that the names of an entry's first five wanted tests point to: of a part test_X those with the stem X or one
    that X ends in behind an underscore, outside of test folders, the first three by path."""
    rows = _entries(spark, sf_dir, "fail_to_pass_results").where("size(fail_to_pass_results) > 0")
    tests = F.slice(F.array_sort(F.map_keys("fail_to_pass_results")), 1, 5)
    parts = F.array_distinct(F.flatten(F.transform(tests, lambda t: F.regexp_extract_all(t, F.lit(r"(?:^|[./: (])test_(\w+)"), F.lit(1)))))
    wanted = rows.select("entry_id", F.explode(parts).alias("part"))
    files = table(spark, sf_dir, "source_files", "file_path").where("lower(file_path) like '%.py' and lower(file_path) not like '%test%'").distinct()
    known = files.select("file_path", F.regexp_extract("file_path", r"([^/]+)\.[A-Za-z]+$", 1).alias("stem"))
    keys = known.select("file_path", F.explode(F.array_distinct(F.array("stem", F.substring_index("stem", "_", -1)))).alias("part"))
    found = wanted.join(keys, "part").select("entry_id", "file_path").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("entry_id").orderBy("file_path")).cast("bigint")).where("rank <= 3")


TEST_SOURCES = rf"""WITH p AS (SELECT DISTINCT entry_id, unnest(flatten([regexp_extract_all(t, '(?:^|[./: (])test_(\w+)', 1) for t in list_sort(map_keys(fail_to_pass_results))[1:5]])) AS part FROM ({ENTRIES}) WHERE cardinality(fail_to_pass_results) > 0),
f AS (SELECT DISTINCT file_path, regexp_extract(file_path, '([^/]+)\.[A-Za-z]+$', 1) AS stem FROM source_files WHERE lower(file_path) LIKE '%.py' AND lower(file_path) NOT LIKE '%test%'),
d AS (SELECT DISTINCT entry_id, file_path FROM p JOIN f ON part = stem OR part = regexp_extract(stem, '([^_]*)$', 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY file_path) AS rank FROM d) SELECT * FROM r WHERE rank <= 3"""

QUERIES = {
    "imported_roots": imported_roots, "test_sources": test_sources,
    "queue_states": queue_states, "variant_summary": variant_summary, "ablation_table": ablation_table, "category_breakdown": category_breakdown, "log_statistics": log_statistics,
    "answer_formats": answer_formats, "answer_blocks": answer_blocks, "replaced_functions": replaced_functions, "log_excerpts": log_excerpts, "test_commands": test_commands, "tool_prompts": tool_prompts,
    "file_views": file_views, "context_views": context_views, "cached_files": cached_files, "file_listing": file_listing, "selected_instances": selected_instances, "open_instances": open_instances, "logged_again": logged_again,
}
ORACLES = {
    "imported_roots": IMPORTED_ROOTS, "test_sources": TEST_SOURCES,
    "queue_states": QUEUE, "variant_summary": VARIANT_SUMMARY, "ablation_table": ABLATION, "category_breakdown": BREAKDOWN, "log_statistics": LOG_STATISTICS,
    "answer_formats": ANSWER_FORMATS, "answer_blocks": ANSWER_BLOCKS, "replaced_functions": REPLACED, "log_excerpts": LOG_EXCERPTS, "test_commands": TEST_COMMANDS, "tool_prompts": TOOL_PROMPTS,
    "file_views": VIEWS, "cached_files": CACHED, "file_listing": LISTING, "selected_instances": SELECTED, "open_instances": OPEN, "logged_again": LOGGED,
}
