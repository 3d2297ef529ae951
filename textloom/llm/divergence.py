"""Source divergence audit by Gustavson's row accumulation.

Terms are counted by language and source, and each language keeps those that enough of its
documents hold.  A group (language and source) gives a kept term the smoothed share
p = 1 + floor(SCALE (count + 1) / (N + V)); its divergence from a peer sums
floor((p - q)^2 / q) over all kept terms.

The terms of a language are dealt to blocks.  In a block, postings lie in an index by term.
Each group in turn takes its row, looks up each of its terms in the index, and adds what the
postings there say into one dense accumulator with a place for each peer; pairs of postings
are never rows.  An accumulator starts as if no term occurred in either group (all terms at
both zero baselines); terms of the group alone, and of the peer alone, are corrected by how
often each count occurs; postings found in the index correct those of both.  All numbers are
whole and exact.  Spark sums the accumulators over blocks.

Cases: null text, lang and source are ''; a language without kept terms has pairs of value 0
and no terms; rows that share an id are documents of their own; an empty table gives no rows;
texts of any length are read in pieces; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.shared import written

SCALE = 1_000_000_000
#: Documents of a language that hold a kept term, at least.
LEAST_DOCS = 3
#: Ranks of part `term`.
TOP = 200
#: Postings of a block, about; a language of many groups has larger blocks, as each gives a row for each pair.
BLOCK = 1 << 14
BLOCK_MAX = 1 << 21
#: Postings that a row meets in the index at once.
REACH = 1 << 20
#: Terms that a task counts before it hands them on, once for each document that they are in.
HELD = 1 << 20
#: Bytes of a text read at once.
PIECE = 1 << 20
#: Groups that are broadcast at most; more are joined by a shuffle.
BROADCAST = 1 << 14

#: Letters and all that is not ASCII are terms; only A-Z change.
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; a piece ends where no term goes on."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and _LOWERED[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_LOWERED).split()
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each language, source and term, and a row without a term for each language and source."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    seen: set[tuple[str, str]] = set()

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms, first = list(n), (lang, source) not in seen
            seen.add((lang, source))
            size = len(terms) + first
            columns = [pa.array([x] * size, pa.string()) for x in (lang, source)]
            columns.append(pa.array(terms + [None] * first, pa.binary()).cast(pa.string()))
            columns += [pa.array([c[t] for t in terms] + [0] * first, pa.int64()) for c in (n, docs)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        found.clear()

    held = 0
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            n, docs = found[lang, source]
            pieces = _pieces(text.as_py())
            here = Counter(next(pieces, []))
            for piece in pieces:
                here.update(piece)
            n.update(here)
            docs.update(here.keys())
            held += len(here)
            if held > HELD:
                yield from handed_on()
                held = 0
    yield from handed_on()


def share(count, size):
    """1 + floor(SCALE (count + 1) / size) of whole columns or arrays, without leaving 64 bits for sizes up to 9 * 10^13."""
    fine = 100_000
    if isinstance(count, Column):
        top = (count + 1) * (SCALE // fine)
        whole = F.call_function("div", top, size)
        return 1 + whole * fine + F.call_function("div", (top % size) * fine, size)
    whole, rest = np.divmod((count + 1) * (SCALE // fine), size)
    return 1 + whole * fine + rest * fine // size


def gap(p, q):
    """floor((p - q)^2 / q)"""
    if isinstance(p, Column):
        return F.call_function("div", (p - q) * (p - q), q)
    return (p - q) ** 2 // q


_PEERS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _accumulate(key: tuple, postings: pa.Table, groups: pa.Table) -> pa.Table:
    """Divergences of all pairs of a language's groups over the terms of one block."""
    lang, block = (k.as_py() for k in key)
    names = groups.column("source").combine_chunks()
    peers = len(names)
    if peers < 2 or (block and not len(postings)):
        return _PEERS.empty_table()
    size = groups.column("kept_n").to_numpy() + groups.column("vocabulary").to_numpy()
    if len(postings):
        base = share(np.zeros(peers, np.int64), size)
        column = postings.column("term").combine_chunks().dictionary_encode()
        terms, term = len(column.dictionary), column.indices.to_numpy().astype(np.int64)
        group = pc.index_in(postings.column("source").combine_chunks(), names).to_numpy().astype(np.int64)
        p = share(postings.column("n").to_numpy(), size[group])
        # the index by term
        by_term = np.argsort(term, kind="stable")
        start = np.concatenate([[0], np.bincount(term, minlength=terms).cumsum()])
        peer_at, share_at = group[by_term], p[by_term]
        # how often each group gives each share
        kinds, often = np.unique(np.column_stack([group, p]), axis=0, return_counts=True)
        kind_peer, kind_share = kinds.T
        by_group = np.argsort(group, kind="stable")
        edges = np.concatenate([[0], np.bincount(group, minlength=peers).cumsum()])
        kind_edges = np.searchsorted(kind_peer, np.arange(peers + 1))
    out = []
    for i in range(peers):
        total = np.zeros(peers, np.int64)
        if len(postings):
            neither = gap(base[i], base)
            total = terms * neither
            # terms of the peer alone, as if the group had none of them
            np.add.at(total, kind_peer, often * (gap(base[i], kind_share) - neither[kind_peer]))
            # terms of the group, as if no peer had them
            step = max(1, REACH // peers)
            for k in range(kind_edges[i], kind_edges[i + 1], step):
                some = slice(k, min(k + step, kind_edges[i + 1]))
                total += (often[some, None] * (gap(kind_share[some, None], base) - neither)).sum(axis=0)
            own = by_group[edges[i] : edges[i + 1]]
            lengths = start[term[own] + 1] - start[term[own]]
            reach = np.concatenate([[0], lengths.cumsum()])
            at = 0
            while at < len(own):
                end = max(at + 1, int(np.searchsorted(reach, reach[at] + REACH, "right")) - 1)
                some, n = own[at:end], lengths[at:end]
                place = np.arange(n.sum()) + np.repeat(start[term[some]] - (reach[at:end] - reach[at]), n)
                peer, q, mine = peer_at[place], share_at[place], np.repeat(p[some], n)
                np.add.at(total, peer, gap(mine, q) - gap(mine, base[peer]) - gap(base[i], q) + neither[peer])
                at = end
        others = np.arange(peers) != i
        columns = [[lang] * (peers - 1), [names[i].as_py()] * (peers - 1), names.filter(pa.array(others)), total[others]]
        out.append(pa.table([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, _PEERS)], schema=_PEERS))
    return pa.concat_tables(out)


def audit_sources(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value and rank: divergence from each other source (`pair`), and the terms most above their language (`term`)."""
    texts = documents.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = texts.mapInArrow(count_terms, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term of a language has one row for each source at most
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"term_docs": F.sum("docs").over(of_term), "lang_count": F.sum("n").over(of_term), "nth": F.row_number().over(of_term.orderBy("source"))})
    kept = F.col("term").isNotNull() & (F.col("term_docs") >= least_docs)
    # rows without a term are read for the groups alone
    counts = written(counts.filter(kept | F.col("term").isNull()).drop("docs", "term_docs"))
    named = F.col("term").isNotNull()
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("kept_n"), F.sum(F.when(named & (F.col("nth") == 1), 1).otherwise(0)).alias("new_terms"), F.count("term").alias("postings"))
    # enough blocks for a language's postings, but no more than its rows by pair are worth
    size = F.least(F.greatest(F.lit(block), F.count("*") * F.count("*")), F.lit(BLOCK_MAX))
    langs = groups.groupBy("lang").agg(F.sum("new_terms").alias("vocabulary"), F.sum("kept_n").alias("lang_n"), F.ceil((F.sum("postings") + 1) / size).alias("blocks"))
    groups = written(groups.drop("new_terms", "postings").join(langs, "lang"))
    postings = counts.filter(named)
    n_groups = groups.count()
    sides = F.broadcast(groups) if n_groups <= BROADCAST else groups
    placed = postings.join(sides, ["lang", "source"])

    dealt = placed.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n")
    everywhere = groups.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    sums = dealt.groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block")).applyInArrow(_accumulate, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    rated = placed.select(
        "lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("kept_n") + F.col("vocabulary")).alias("p"), share(F.col("lang_count"), F.col("lang_n") + F.col("vocabulary")).alias("q")
    )
    terms = rated.filter("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    every = pairs.withColumn("rank", F.row_number().over(order))
    out = ("lang", "source", "part", "item", "value", "rank")
    return every.withColumn("part", F.lit("pair")).select(*out).unionByName(ranked.withColumn("part", F.lit("term")).select(*out))


#: The same in DuckDB, with every kept term of every group as a row.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), found AS (SELECT row_id, lang, source, unnest(terms) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS c FROM found GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3
), vocabulary AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
), cells AS (SELECT lang, source, term, count(*) AS c FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (SELECT lang, source, sum(c) AS n FROM cells GROUP BY lang, source
), groups AS (SELECT DISTINCT lang, source FROM docs
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(s.n, 0) + v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.c + 1)) // (v.n + v.v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every) WHERE part = 'pair' OR rank <= 200
"""
