"""Pages made of keywords, links or product tags instead of sentences.

A text is cut into lines and sentences, and each of these into terms. For every term the lags at which it comes again are
looked at: its autocorrelation over lag windows of up to LAGS places, and, where no sentence ends between them, the
distance at which it comes again between the same neighbours, whatever it is, as in a cycle of keywords. How close
a term's places usually are, against what chance gives at its frequency, also tells over all documents which terms belong
to prose: those that come again often but evenly, as function words do in any language, while keywords come in
bursts. With these, the links and the tags of a piece it is told whether it is content; the page is decided by the
characters of its pieces.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.distinct import rows_once
from millrace.session import checkpointed

#: A term that recurs within NEAR places counts always, within LAGS places if both neighbours are others.
NEAR, LAGS = 4, 12
#: Share of recurring content terms, and of prose words, from and up to which a piece is keywords.
RECURRING, PROSE_WORDS = 0.55, 0.4
#: The same for pieces with links or tags, where recurrence isn't asked for.
LIST_PROSE_WORDS, TAG_SHARE = 0.15, 0.2
#: So many terms without a prose word and without the end of a sentence are a list of nouns, if so large a part of them is
#: different and known.
NOUN_LIST, NOUNS_KNOWN = 8, 0.6
#: A known noun stands in so many documents at least.
KNOWN = 3
#: A prose word stands in this share of the documents at least, and of the further places of a document that has it, it takes a
#: share between these two.
WORD_DOCUMENTS, WORD_RATE, WORD_MOST = 0.01, 0.004, 0.1
#: Its places share a run at most so many times as often as chance has it, and this share above that.
WORD_CLUSTERED, WORD_SLACK = 2.0, 0.1
#: So many learned words are broadcast at most; beyond that the terms are shuffled to them.
BROADCAST_WORDS = 200_000
#: Short pieces are judged together, in runs of about so many terms.
RUN = 8
#: Share of a page's characters above which it is no content. It is below a half, because single keywords between
#: the pieces that were found stay uncounted.
SPAM_SHARE = 0.45

#: An explicit link, and a host name with a path or with a top-level domain that is known.
LINK = r"(?:https?://|www\.)[^\s\])>\"']+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,7}/[^\s\])>\"']*"
HOST = r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:%s)\b"
#: There are fewer top-level domains than this; of more endings of hosts the commonest are taken.
DOMAINS = 2000
TERM = r"[\u3041-\u309f]+|[\u30a0-\u30ff]+|\p{IsHan}{1,2}|[\p{L}\p{N}&&[^\u3041-\u30ff\p{IsHan}]]+"
#: Code, logs, tables and names of programs.
TECHNICAL = r"[(){}=\\_`]|::|\.[a-z]{1,4}\b|[a-z][A-Z]"
TECHNICAL_LINE = r"(?m)^\s*(?:\d{2}:\d{2}|@@|\||Traceback)|={4,}|-{6,}"
#: Share of a run's characters, in words with such signs and in such lines, from which it is technical.
TECHNICAL_SHARE = 0.15
#: Hash tags, pairs of a name and a joined value, short labels with a long number, prices.
TAG = r"(?:^|\s)#[\p{L}\p{N}_]+|\b[\p{L}\p{N}_]+:[\p{L}\p{N}_-]+-[\p{L}\p{N}_]+|\b\p{Lu}\p{L}{1,3}[.:#\s]*\d{3,}|\p{Sc}\s?\d"


def plain_letters() -> tuple[str, str]:
    """Letters with accents and full-width characters, and the plain ones they stand for, by Unicode decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x400, 0x460), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base != chr(code) and not unicodedata.combining(base):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def link_pattern(documents: DataFrame) -> str:
    """A pattern of links: explicit ones, and bare hosts whose top-level domain explicit links of at least KNOWN documents
    have."""
    hosts = F.regexp_extract_all(F.lower("text"), F.lit(r"https?://[a-z0-9.-]*\.([a-z]{2,24})(?![a-z0-9.-])"), F.lit(1))
    ends = documents.where("text like '%://%'").select(F.explode(F.array_distinct(hosts)).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= KNOWN)
    known = sorted(r.end for r in ends.orderBy(F.desc("n"), "end").limit(DOMAINS).collect())
    return f"{LINK}|{HOST % '|'.join(known)}" if known else LINK


def pieces(documents: DataFrame, url: str = LINK) -> DataFrame:
    """(doc_id, uid, k, size, link, ends, technical, tags, terms): lines, and sentences within lines, in order. ``size`` are the
    characters of the piece but for white space, ``link`` whether it has a link, ``ends`` whether a sentence ends with it,
    ``technical`` the characters of its words of code, or of the whole line, ``tags`` its product tags, and ``terms`` its
    words without markup and links, as hashes of which those of words with digits are odd, of others even."""
    before, after = plain_letters()
    text = F.translate(F.regexp_replace("text", r"[\u0300-\u036f]", ""), before, after)
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("uid"), text.alias("text")).repartition("doc_id")
    cut = rows.select("doc_id", "uid", F.posexplode(F.split("text", r"(?<=\n)|(?<=[.!?。])(?=\s|[^\x00-\x7F])")).alias("k", "piece"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("piece", "<[^>]*>", " "), url, " "), r"\]\(\s*\)", "] ")
    cut = cut.select("doc_id", "uid", "k", "piece", F.length(F.regexp_replace("piece", r"(?U)\s", "")).alias("size"), bare.alias("bare"))
    words = F.filter(F.split("bare", r"[\s\u3041-\u30ff\p{IsHan}]+"), lambda w: w.rlike(TECHNICAL))
    return cut.select(
        "doc_id", "uid", "k", "size",
        F.col("piece").rlike(r"[.!?。][\s\p{Pe}\p{Pf}\"']*$").alias("ends"),
        F.when(F.col("bare").rlike(TECHNICAL_LINE), F.col("size")).otherwise(F.length(F.array_join(words, ""))).alias("technical"),
        (F.contains("piece", F.lit("<a ")) | F.col("piece").rlike(url)).alias("link"),
        F.regexp_count("bare", F.lit(TAG)).alias("tags"),
        F.transform(F.regexp_extract_all("bare", F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(F.lower(t)).bitwiseAND(-2) + t.rlike("[0-9]").cast("int")).alias("terms"),
    )


def in_runs(rows: DataFrame) -> DataFrame:
    """``pieces`` with ``start``, the place of the first term on the page, ``part``, the number of sentences that ended
    before, and ``run``: pieces with a link stand alone, others join those that begin in the same RUN places."""
    before = Window.partitionBy("doc_id", "uid").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.size("terms")).over(before) - F.size("terms")
    part = F.sum(F.col("ends").cast("int")).over(before) - F.col("ends").cast("int")
    return rows.withColumns({"start": start, "part": part}).withColumn("run", F.when(F.col("link"), -1 - F.col("k")).otherwise(F.floor(F.col("start") / RUN)))


def known_terms(rows: DataFrame) -> DataFrame:
    """(term, prose) of the terms in at least KNOWN texts: whether a term is one of prose.

    Such a term stands in WORD_DOCUMENTS of all texts, takes WORD_RATE to WORD_MOST of the further places of those that
    have it, and these are about as far apart as chance has it at that rate: a place is close if it shares a run of RUN
    places with another of the term. Pieces with links and tags, whose labels come as evenly, and terms with digits
    are left out; copies of a text count once. No window is needed: places and runs are counted with partial aggregation.
    """
    plain = rows.where("not link and tags = 0")
    placed = F.transform("terms", lambda t, i: F.struct(t.alias("term"), F.floor((F.col("start") + i) / RUN).alias("at")))
    own = F.filter(placed, lambda x: x["term"].bitwiseAND(1) == 0)
    # Each piece gives a term once for each run it has there, with the number of its places in it.
    runs = F.transform(F.array_distinct(own), lambda d: F.struct(d["term"].alias("term"), F.size(F.filter(own, lambda x: x == d)).alias("n")))
    per_copy = plain.select("uid", "doc_id", F.explode(runs).alias("r")).groupBy("uid", "doc_id", "r.term").agg(F.sum("r.n").alias("n"), F.count(F.lit(1)).alias("runs"))
    per_text = per_copy.groupBy("uid", "term").agg(F.max("n").alias("n"), F.max("runs").alias("runs"))
    sizes = plain.groupBy("uid", "doc_id").agg(F.sum(F.size("terms")).alias("size")).groupBy("uid").agg(F.max("size").alias("size"))
    total = sizes.agg(F.count(F.lit(1)).alias("texts"))
    terms = per_text.join(sizes, "uid").groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.col("n") - 1).alias("more"), F.sum(F.col("size") - 1).alias("room"), F.sum(F.col("n") - F.least("n", "runs")).alias("close")
    ).where(F.col("df") >= KNOWN)
    rate = F.col("more") / F.greatest("room", F.lit(1))
    # Of a term's places in a run of RUN all but the first are close; so many of them chance has at this rate.
    chance = 1 - (1 - F.pow(1 - rate, F.lit(RUN))) / (RUN * rate)
    even = F.col("close") <= (WORD_CLUSTERED * chance + WORD_SLACK) * F.col("more")
    prose = (F.col("df") >= WORD_DOCUMENTS * F.col("texts")) & rate.between(WORD_RATE, WORD_MOST) & even
    return terms.crossJoin(F.broadcast(total)).select("term", F.coalesce(prose, F.lit(False)).alias("prose"))


def recurring_terms(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, uid, run, n, prose, recurring, nouns): terms of each run, prose words, other terms that recur, and how many
    different other terms are known.

    The autocorrelation is a window over the places of a page with one lag for each distance up to LAGS: a term recurs if it
    stands within NEAR places on either side, or if its nearest other place is within LAGS and has other neighbours. A
    second window over the places with equal neighbours and no end of a sentence between gives the distance at which
    a term comes again, whatever it is; of these regular distances the commonest in a run counts.
    """
    terms = rows.select("doc_id", "uid", "run", "part", "start", F.posexplode("terms").alias("i", "term")).withColumn("place", F.col("start") + F.col("i"))
    by_place = Window.partitionBy("doc_id", "uid").orderBy("place")
    lags = {k: (F.lag if k > 0 else F.lead)("term", abs(k)).over(by_place).alias(f"l{k}") for k in range(-LAGS - 1, LAGS + 2) if k}
    seen = terms.select("doc_id", "uid", "run", "part", "term", "place", *lags.values())
    at = lambda k: F.col(f"l{k}") if k else F.col("term")

    def recurs(side: int) -> Column:
        rule = None
        for k in range(1, LAGS + 1):
            # The neighbours of a place are one lag less and one more.
            others = ~at(side * k + 1).eqNullSafe(at(1)) & ~at(side * k - 1).eqNullSafe(at(-1))
            found = F.lit(True) if k <= NEAR else others
            same = at(side * k) == F.col("term")
            rule = F.when(same, found) if rule is None else rule.when(same, found)
        return rule.otherwise(False)

    context = F.xxhash64("term", "l1", "l-1", "part")
    marked = seen.select("doc_id", "uid", "run", "term", "place", context.alias("context"), (recurs(1) | recurs(-1)).alias("near"))
    by_context = Window.partitionBy("doc_id", "uid", "context").orderBy("place")
    gap = F.coalesce(F.col("place") - F.lag("place").over(by_context), F.lead("place").over(by_context) - F.col("place"))
    few = F.broadcast(known) if known.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else known
    found = marked.withColumn("gap", gap).join(few, "term", "left").withColumn("other", ~F.coalesce("prose", F.lit(False)))
    key = ["doc_id", "uid", "run"]
    by_gap = found.groupBy(*key, "gap").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("other")).alias("prose"), F.count_if(F.col("other") & F.col("near")).alias("near"),
        F.count_if(F.col("other") & ~F.col("near")).alias("far"), F.collect_set(F.when(F.col("other") & F.col("prose").isNotNull(), F.col("term"))).alias("nouns"),
    )
    periodic = F.max(F.when(F.col("gap").isNotNull(), F.col("far")).otherwise(0))
    per_run = by_gap.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("prose").alias("prose"), (F.sum("near") + periodic).alias("recurring"), F.collect_list("nouns").alias("nouns"))
    return per_run.withColumn("nouns", F.size(F.array_distinct(F.flatten("nouns"))))


def spam_shares(documents: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(doc_id, share): the share of a page's characters, but for white space, that stand in keywords, lists of links
    or tags, from 0 to 1. Null, empty and blank texts have no row; where a doc_id has several texts the largest counts.

    Words of prose are learned from the ``documents`` themselves; where these are few, a larger collection may be given as
    ``reference``(doc_id, text) for it.
    """
    url = link_pattern(documents if reference is None else reference)
    rows = checkpointed(in_runs(pieces(documents, url)))
    known = checkpointed(known_terms(rows if reference is None else in_runs(pieces(reference, url))))
    runs = rows.groupBy("doc_id", "uid", "run").agg(
        F.sum("size").alias("size"), F.bool_or("link").alias("link"), (F.sum("technical") >= TECHNICAL_SHARE * F.sum("size")).alias("technical"), F.sum("tags").alias("tags"), F.bool_or("ends").alias("ends")
    )
    found = runs.join(recurring_terms(rows, known), ["doc_id", "uid", "run"], "left").na.fill(0, ["n", "prose", "recurring", "nouns"])
    content = F.col("n") - F.col("prose")
    few = F.col("prose") <= LIST_PROSE_WORDS * F.col("n")
    spam = ~F.col("technical") & (
        (F.col("link") & few)
        | ((F.col("tags") > 0) & few & (F.col("tags") >= TAG_SHARE * F.col("n")))
        | ((content >= 2) & (F.col("prose") <= PROSE_WORDS * F.col("n")) & (F.col("recurring") >= RECURRING * content))
        | ((F.col("n") >= NOUN_LIST) & ~F.col("ends") & (F.col("prose") == 0) & (F.col("nouns") >= NOUNS_KNOWN * F.col("n")))
    )
    per_text = found.groupBy("doc_id", "uid").agg(F.sum("size").alias("size"), F.sum(F.when(spam, F.col("size")).otherwise(0)).alias("spam")).where("size > 0")
    return per_text.groupBy("doc_id").agg(F.max(F.col("spam") / F.col("size")).alias("share"))


def spam_pages(documents: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(doc_id) of the pages of ``documents``(doc_id, text) that are keyword-stuffed or lists of links or tags."""
    rows = rows_once(documents.select("doc_id", "text"), "doc_id")
    return spam_shares(rows, reference).where(F.col("share") > SPAM_SHARE).select("doc_id")


def spam_rates(documents: DataFrame) -> DataFrame:
    """(source, n_docs, n_spam, rate) for ``documents``(doc_id, text, source); a null source is '?'."""
    rows = rows_once(documents.select("doc_id", "text", "source"), "doc_id")
    flags = spam_pages(rows).withColumn("hit", F.lit(1))
    return (
        rows.select("doc_id", F.coalesce("source", F.lit("?")).alias("source")).join(flags, "doc_id", "left").groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count("hit").alias("n_spam")).withColumn("rate", F.round(F.col("n_spam") / F.col("n_docs"), 6))
    )
