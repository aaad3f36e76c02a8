"""Repeated byte strings: common-prefix interval trees over sparse suffix arrays.

Wanted are the maximal repeats of `least` bytes and more, and among them those of `width` and more, which are
removed. Every window of `least` bytes has an anchor: the place in it of the least hash of `gram` bytes,
so equal strings have equal anchors at equal places. Of equals it is the last or, where they begin inside the window, the first,
so that a stretch of periodic text has few. A window that is equal to the one a period on is known to be a repeat; the last
of such windows stand for all. An anchor's context is
all bytes of the strings of `width` bytes around its gram. Contexts that share the gram are the only
ones that can hold equal strings. Their suffixes, starting at the anchors, are the array; what stands
before the anchors tells about extension to the left.

1. Anchors that occur once, nearly all of them, are dropped by counts of their hashes alone.
2. Contexts with equal bytes are one context; if it occurs twice, all of it is repeated. Copies of
   whole documents end here, however many. Where they follow one another in a document of
   periodic text, they are one row.
3. Contexts that share an anchor but differ, at the rims of repeats, are compared: their suffixes are sorted,
   the common prefixes of neighbours scanned with a stack into the interval tree, and every interval's
   members compared to the left. An interval whose members go on differently to the left is a maximal
   repeat, with all its members as occurrences; long enough ones are covered.
   An anchor with more than `split` different contexts, of a line that many documents share, is parted first:
   contexts with a repeat of `least` bytes in common agree in one of a few strings of four fifths of that
   length around the anchor, each a deeper interval. One of these with more than `most` contexts is not gathered:
   the digests of all windows about the anchor, of either size, are counted instead, which names the intervals of that depth.

Edge cases: null counts as empty; matches never cross documents; texts under `least` bytes have none;
rows that repeat an id and text are two documents with equal strings; empty tables give no rows; other
columns are ignored. Contexts that share a gram are told apart by digests of 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import kernels, util

WIDTH, LEAST, GRAM = 400, 250, 50  # a string of 250 bytes is less than 50 words of prose
WORDS = 50
PLACE = 32  # bits of a place: a text has fewer bytes than 2 ** 31


def least_places(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each i, the places of the first and the last of the least of h[i : i + w]; for len(h) - w + 1 places i.

    Places stand in the low bits of the hashes, whose high bits decide: equal strings have them in equal order,
    and as many high bits decide in every list of texts, long or short.
    """
    low = np.uint64((1 << PLACE) - 1)
    place = np.arange(len(h), dtype=np.uint64)

    def least(best: np.ndarray) -> np.ndarray:
        have = 1
        while have < w:
            step = min(have, w - have)
            np.minimum(best[:-step], best[step:], out=best[:-step])  # each place is read before it is written
            have += step
        return best[: len(h) - w + 1] & low

    high = h & ~low
    return least(high | place).astype(np.int64), (low - least(high | (low - place))).astype(np.int64)


def runs(starts: np.ndarray, size: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs (starts, ends) that windows of this size cover, which begin at these places in order; doc: the document of each, in which its run ends."""
    first = np.flatnonzero(np.append(True, (np.diff(starts) > size) | (np.diff(doc) != 0))) if len(starts) else np.empty(0, dtype=np.int64)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1] + size if len(starts) else first


def anchors(raw: list[bytes], width: int, least: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors of all windows of `least` bytes: doc, first, last and n, fp of the gram and c of the context.

    Anchors of equal contexts that touch each other are one, from `first` to `last`. Rows with n = 0 are
    repeats by themselves, from `first` to `last`, exclusive, of windows of c bytes.
    """
    names = ("doc", "first", "last", "n", "fp", "c")
    size = np.array([len(r) for r in raw], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if len(data) < least:
        return {k: np.empty(0, dtype=np.int64) for k in names}
    prefix = kernels.prefix_hash(data)
    starts = np.arange(len(data) - gram + 1)
    h = kernels.span_hash(prefix, starts, starts + gram)
    at, last = least_places(h, least - gram + 1)
    keep = np.repeat(size >= least, size)[: len(at)]  # windows that lie in one document
    for a, b in zip(begin[1:] - least + 1, begin[1:]):
        keep[max(0, a) : b] = False

    own = []
    x = np.flatnonzero(keep & (at != last))
    if len(x):
        value = h >> np.uint64(PLACE)
        place, of = np.unique(at[x], return_inverse=True)
        period = np.zeros(len(place), dtype=np.int64)  # to the next of equals
        todo = np.arange(len(place))
        for step in range(1, least - gram + 1):
            near = todo[place[todo] + step < len(value)]
            hit = near[value[place[near] + step] == value[place[near]]]
            period[hit] = step
            todo = todo[period[todo] == 0]
            if not len(todo):
                break
        p = period[of]
        at[x] = np.where((at[x] - x >= p) & (p > 0), at[x], last[x])
        end = begin[np.searchsorted(begin, x, "right")]
        for n in (width, least):
            fits = (p > 0) & (x + p + n <= end)
            y, q = x[fits], p[fits]
            same = kernels.span_hash(prefix, y, y + n) == kernels.span_hash(prefix, y + q, y + q + n)
            y, q = y[same], q[same]
            both = np.unique(np.concatenate([y, y + q]))
            a, b = runs(both, n, np.searchsorted(begin, both, "right"))
            d = np.searchsorted(begin, a, "right") - 1
            own.append((d, a - begin[d], b - begin[d], np.full(len(a), n)))
        step = np.zeros(len(at) + least, dtype=np.int64)
        step[y] = q
        keep[y[step[y + q] == q]] = False  # the window a period on, and the one after it, are equal to this one

    at = at[keep]
    at = np.unique(at[np.append(True, at[1:] != at[:-1])]) if len(at) else at
    doc = np.searchsorted(begin, at, "right") - 1
    start, end = np.maximum(at + gram - width, begin[doc]), np.minimum(at + width, begin[doc + 1])
    c = kernels.span_hash(prefix, start, end) ^ kernels.mix((at - start).astype(np.uint64))
    fp, c = h[at].view(np.int64), c.view(np.int64)
    order = np.lexsort((at, c, fp, doc))
    doc, fp, c, at = doc[order], fp[order], c[order], at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1]) | (c[1:] != c[:-1]) | (at[1:] - at[:-1] > 2 * width - gram)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1 if len(head) else head
    found = [(doc[head], at[head] - begin[doc[head]], at[tail] - begin[doc[head]], tail - head + 1, fp[head], c[head])]
    found += [(d, a, b, np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64), n) for d, a, b, n in own]
    return {k: np.concatenate(v) for k, v in zip(names, zip(*found))}


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(length, first, last) of each interval of a suffix array with these common prefixes of neighbours (lcp[i] of i - 1 and i)."""
    out, stack = [], [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            out.append((length, first, i - 1))
        if not stack or stack[-1][0] < now:
            stack.append((now, first))
    return out


def repeats(members: list[tuple[bytes, int]], sizes: tuple[int, ...]) -> list[list[tuple[int, int, int]]]:
    """For each (bytes, place of the anchor) of different contexts that share an anchor, and for each size: (start, end, size) of what its repeats of at least this size cover.

    All repeats hold the anchor's gram, so they cover one run.
    """
    right = [b[a:] for b, a in members]
    left = [b[:a][::-1] for b, a in members]
    reached = [[[0, 0] for _ in sizes] for _ in members]
    order = sorted(range(len(members)), key=right.__getitem__)
    lcp = [0] + [common(right[i], right[j]) for i, j in zip(order, order[1:])]
    place = {i: k for k, i in enumerate(sorted(range(len(members)), key=left.__getitem__))}
    for length, first, last in intervals(lcp):
        if last == first or not length:
            continue
        group = sorted(order[first : last + 1], key=place.__getitem__)
        back = [common(left[i], left[j]) for i, j in zip(group, group[1:])]  # left extension, longest to a neighbour in this order
        for k, i in enumerate(group):
            reach = max(back[k - 1] if k else 0, back[k] if k < len(back) else 0)
            for size, best in zip(sizes, reached[i]):
                if reach + length >= size:
                    best[0], best[1] = max(best[0], reach), max(best[1], length)
    return [[(a - x, a + y, size) for size, (x, y) in zip(sizes, best) if y] for (_, a), best in zip(members, reached)]


def repeated_spans(docs: DataFrame, width: int = WIDTH, least: int = LEAST, gram: int = GRAM, most: int = 20_000, split: int = 256) -> DataFrame:
    """(d, th, start, end, size): bytes that repeats of at least `size`, which is `least` or `width`, cover, by document key.

    Every string of that size that occurs twice lies in one. With size 0 what lies between the ends is one repeat, which counts for
    every size that it has; these ends may lie outside of the document, where it cuts a context.
    """
    d, th = util.key_of(F.col("doc_id"), F.col("text"))
    texts = docs.select(d.alias("d"), th.alias("th"), "text")

    def cut(batches):
        for pdf in batches:
            for first, part in kernels.chunks(pdf["text"], 1 << 18):
                found = anchors([kernels.utf8(t) for t in part], width, least, gram)
                of = pdf.iloc[first : first + len(part)]
                doc = found.pop("doc")
                yield pd.DataFrame({"d": of["d"].to_numpy()[doc], "th": of["th"].to_numpy()[doc], **found})

    every = util.stash(texts.mapInPandas(cut, "d long, th long, first int, last int, n int, fp long, c long"))
    own = util.stash(every.where("n = 0").select("d", "th", F.col("first").alias("start"), F.col("last").alias("end"), F.col("c").cast("int").alias("size")))
    several = every.where("n > 0")
    shared = several.groupBy("fp").agg(F.sum("n").alias("seen"), (F.min("c") != F.max("c")).alias("differ")).where("seen > 1")
    # The hint deals the counts out anew, so that the join can split an anchor that a third of all contexts share.
    several = util.stash(several.join(shared.select("fp", "differ").hint("rebalance"), "fp"), instead_of=[every])
    contents = several.groupBy("fp", "c", "differ").agg(F.sum("n").alias("n"), F.min(F.struct("d", "th", "first")).alias("one"))
    whole = several.join(contents.where("n > 1").select("fp", "c").hint("rebalance"), ["fp", "c"])
    whole = whole.select("d", "th", (F.col("first") + (gram - width)).alias("start"), (F.col("last") + width).alias("end"), F.lit(0).alias("size"))

    differing = util.stash(contents.where("differ").select("fp", "n", "one.*"))
    many = differing.groupBy("fp").agg((F.count(F.lit(1)) > min(split, most)).alias("many")).hint("rebalance")
    wanted = differing.join(many, "fp").groupBy("d", "th").agg(F.collect_list(F.struct("fp", (F.col("n") == 1).alias("alone"), "first", "many")).alias("w"))
    wanted = wanted.select("d", "th", *[F.col(f"w.{c}").alias(c) for c in ("fp", "alone", "first", "many")])  # arrays of numbers take less room in Python than structs

    def fetch(batches):
        names = ["fp", "many", "alone", "d", "th", "start", "anchor", "bytes"]
        for pdf in batches:
            out = []
            for d, th, text, fp, alone, first, many in zip(*(pdf[c] for c in ("d", "th", "text", "fp", "alone", "first", "many"))):
                raw = kernels.utf8(text)
                for f, a, at, m in zip(fp.tolist(), alone.tolist(), first.tolist(), many.tolist()):
                    start = max(0, at + gram - width)
                    out.append((f, m, a, d, th, start, at - start, raw[start : at + width]))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    gathered = util.stash(texts.join(wanted, ["d", "th"]).mapInPandas(fetch, "fp long, many boolean, alone boolean, d long, th long, start int, anchor int, bytes binary"), instead_of=[differing])

    sizes = tuple({least: 0, width: 0})

    def solve(batches):
        """Of each anchor; rows that repeat an id and text bring a context twice."""

        def done(rows):
            unique = list({r[1:4]: r for r in rows}.values()) if len(rows) > 1 else rows
            if len(unique) > 1 and any(r[0] for r in unique):
                for r, spans in zip(unique, repeats([(r[5], r[4]) for r in unique], sizes)):
                    if r[0]:
                        out.extend((r[1], r[2], r[3] + a, r[3] + b, size) for a, b, size in spans)

        at, rows, out, names = None, [], [], ["d", "th", "start", "end", "size"]
        for pdf in batches:
            for g, *r in zip(*(pdf[c].tolist() for c in ("g", "alone", "d", "th", "start", "anchor", "bytes"))):
                if g != at:
                    done(rows)
                    at, rows = g, []
                rows.append(tuple(r))
            yield pd.DataFrame(out, columns=names)
            out.clear()
        done(rows)
        yield pd.DataFrame(out, columns=names)

    context = ["fp", "d", "th", "start"]
    hot = gathered.where("many")
    parts, step = 5, least // 5
    around = []
    for i in range(gram // step, parts):  # fewer bytes to the right than the gram's are always shared
        left, right = (parts - 1 - i) * step, i * step
        key = F.expr(f"xxhash64(substring(bytes, anchor + 1 - {left}, {left + right}))")
        around.append(F.when((F.col("anchor") >= left) & (F.length("bytes") - F.col("anchor") >= right), F.struct(F.lit(i).alias("i"), key.alias("key"))))
    named = hot.select(*context, F.explode(F.array_compact(F.array(*around))).alias("p")).select(*context, "p.*")
    agree = named.groupBy("fp", "i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("rebalance")
    parted = util.stash(named.join(agree, ["fp", "i", "key"]).select(*context, F.xxhash64("fp", "i", "key").alias("g"), "n"))

    moved = ["alone", "d", "th", "start", "anchor", "bytes"]
    few = gathered.where("not many").select(F.col("fp").alias("g"), *moved).unionAll(hot.join(parted.where(F.col("n") <= most), context).select("g", *moved))
    rims = few.repartition("g").sortWithinPartitions("g").mapInPandas(solve, "d long, th long, start int, end int, size int")

    def windows(batches):
        """Digests of all windows about the anchor of the contexts that have too many others to gather."""
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                data = np.frombuffer(r.bytes, dtype=np.uint8)
                one, two = kernels.prefix_hash(data), kernels.prefix_hash(data, kernels.BYTE2, kernels.BASE2)
                for size in sizes:
                    at = np.arange(max(0, r.anchor + gram - size), min(r.anchor, len(data) - size) + 1)
                    w1, w2 = kernels.span_hash(one, at, at + size), kernels.span_hash(two, at, at + size, kernels.BASE2)
                    yield pd.DataFrame({"d": r.d, "th": r.th, "start": r.start + at, "end": r.start + at + size, "size": size, "w1": w1.view(np.int64), "w2": w2.view(np.int64)})

    crowd = hot.join(parted.where(F.col("n") > most).select(*context).distinct(), context, "left_semi").select("d", "th", "start", "anchor", "bytes")
    each = crowd.mapInPandas(windows, "d long, th long, start int, end int, size int, w1 long, w2 long").distinct()
    twice = each.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("rebalance")
    counted = each.join(twice, ["w1", "w2"]).select("d", "th", "start", "end", "size")
    return whole.unionAll(own).unionAll(rims).unionAll(counted)


def union_of(starts, ends, sizes, length: int, least: int) -> list[tuple[int, int]]:
    """The maximal runs that repeats of `least` bytes and more cover in a document of this length; arguments as `repeated_spans` has them."""
    if starts is None or not len(starts):
        return []
    a, b = np.maximum(starts, 0), np.minimum(ends, length)
    keep = np.where(sizes == 0, b - a >= least, sizes == least)
    order = np.argsort(a[keep], kind="stable")
    a, b = a[keep][order], np.maximum.accumulate(b[keep][order])
    if not len(a):
        return []
    first = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return list(zip(a[first].tolist(), b[np.append(first[1:], len(a)) - 1].tolist()))


def removed(docs: DataFrame, width: int = WIDTH, least: int = LEAST, gram: int = GRAM, most: int = 20_000, split: int = 256) -> DataFrame:
    """docs' doc_id and text with `starts`, `ends` and `sizes` of all repeats, as `repeated_spans` has them (null: none)."""
    spans = repeated_spans(docs, width, least, gram, most, split).groupBy("d", "th").agg(F.collect_set(F.struct("start", "end", "size")).alias("s"))
    spans = spans.select(F.col("d").alias("d_"), F.col("th").alias("th_"), F.col("s.start").alias("starts"), F.col("s.end").alias("ends"), F.col("s.size").alias("sizes"))
    d, th = util.key_of(F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", "text").join(spans, (d == F.col("d_")) & (th == F.col("th_")), "left").select("doc_id", "text", "starts", "ends", "sizes")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the fixed columns: n_passages, the maximal runs of bytes covered by repeats of `LEAST` bytes and more that have `WORDS` words at least, and whether there is one."""

    def digest(batches):
        for pdf in batches:
            out = []
            for text, *spans in zip(pdf["text"], pdf["starts"], pdf["ends"], pdf["sizes"]):
                raw = kernels.utf8(text) if isinstance(text, str) else b""
                runs = union_of(*spans, len(raw), WIDTH)
                passages = sum(len(raw[a:b].split()) >= WORDS for a, b in union_of(*spans, len(raw), LEAST))
                kept, at = hashlib.sha256(), 0
                for a, b in [*runs, (len(raw), len(raw))]:
                    kept.update(raw[at:a])
                    at = b
                out.append((len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), passages, passages > 0))
            got = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "repeats_passage"])
            got.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield got

    found = removed(util.table(spark, sf_dir, "documents"))
    return found.mapInPandas(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, repeats_passage boolean")


SQL = """
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT size, doc_id, i, hash(substring(x, 2 * i + 1, 2 * size)) AS k FROM (SELECT size, doc_id, x, unnest(range(len(x) // 2 - size + 1)) AS i FROM h, (VALUES (250), (400)) AS t(size) WHERE len(x) >= 2 * size)),
c AS (SELECT size, doc_id, i FROM w WHERE (size, k) IN (SELECT (size, k) FROM w GROUP BY size, k HAVING count(*) > 1)),
n AS (SELECT size, doc_id, i, CASE WHEN i - lag(i) OVER d > size THEN 1 ELSE 0 END AS new FROM c WINDOW d AS (PARTITION BY size, doc_id ORDER BY i)),
g AS (SELECT size, doc_id, i, sum(new) OVER (PARTITION BY size, doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM n),
r AS MATERIALIZED (SELECT size, doc_id, min(i) AS a, max(i) + any_value(size) AS b FROM g GROUP BY size, doc_id, g),
s AS (SELECT doc_id, a, b FROM r WHERE size = 400),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT p.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substring(x, 2 * m + 1)) AS kept
      FROM p JOIN h USING (doc_id) JOIN (SELECT doc_id, max(b) AS m FROM s GROUP BY doc_id) USING (doc_id) GROUP BY p.doc_id),
-- bytes with a comma after each, then parted at white space
t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(substring(x, 2 * a + 1, 2 * (b - a)), '(..)', '\\1,', 'g'), '(20|09|0A|0B|0C|0D),', '|', 'g'), '|') AS parts FROM r JOIN h USING (doc_id) WHERE size = 250),
q AS (SELECT doc_id, count(*) AS n_passages FROM t WHERE len(list_filter(parts, lambda x: x <> '')) >= 50 GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256,
       coalesce(n_passages, 0) AS n_passages, n_passages IS NOT NULL AS repeats_passage
FROM h LEFT JOIN k USING (doc_id) LEFT JOIN q USING (doc_id)
"""
