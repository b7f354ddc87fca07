"""Cleanup of recognised text, and tolerant matching in it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.nearness import hold_nearly, words_nearly
from ..functions.text import collapse_ws, ocr_fold, strip_ws
from .search import match_ocr_exactly, ocr_hits

#: Words that stand for one another on greeting cards.
SYNONYMS = {w: ("birthday", "compleanno", "happybirthday", "buoncompleanno") for w in ("birthday", "compleanno")}

def match_ocr_tolerant(df: DataFrame, text_col: str, terms: list[str], synonyms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows whose recognised text holds every term, errors allowed; `stage` is 1 for an exact form and 2 for a fuzzy one.

    Native forms decide first, and texts are read once; only what they leave goes
    to Python, where windows of many texts are compared side by side.
    """
    synonyms = SYNONYMS if synonyms is None else synonyms
    wanted = [[w for w in synonyms.get(t.lower(), (t.lower(),))] for t in terms if t]
    table = str.maketrans({"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "|": "i", "!": "i", "l": "i", "$": "s", "@": "a"})
    folded = [["".join(c for c in w.translate(table) if c.isalnum()) for w in words] for words in wanted]

    def fuzzy(sign: pa.Array, hits: pa.Array) -> pa.Array:
        left = sign.is_valid().to_numpy(zero_copy_only=False)  # null where all terms are held exactly
        own = np.array([h or [True] * len(folded) for h in hits.to_pylist()], bool).reshape(len(sign), len(folded))
        for k, words in enumerate(folded):
            for word in words:
                rows = np.flatnonzero(left & ~own[:, k])
                signs = ((r, s + s[::-1]) for r, s in zip(rows.tolist(), sign.take(pa.array(rows)).to_pylist(), strict=True))
                own[:, k] |= hold_nearly(signs, word, len(sign), mirrored=True)
            left &= own[:, k]
        return pa.array(left, pa.bool_())

    # as if not deterministic, so that no filter is moved below and hits are worked out once a row
    near = F.arrow_udf(fuzzy, "boolean").asNondeterministic()
    if not wanted:
        return df.where(F.lit(False)).withColumn("stage", F.lit(1))
    tried = df.withColumn("__hits", ocr_hits(F.col(text_col), [t for t in terms if t], synonyms))
    exact = F.forall("__hits", lambda h: h)
    tried = tried.withColumn("__near", near(F.when(~exact, ocr_fold(F.col(text_col))), F.col("__hits")))
    return tried.where(exact | F.col("__near")).withColumn("stage", F.when(exact, 1).otherwise(2)).drop("__hits", "__near")


def match_labels(df: DataFrame, labels_col: str, terms: list[str]) -> DataFrame:
    """Rows whose labels together hold every term, errors allowed."""
    joined = df.withColumn("__labels", F.array_join(F.transform(labels_col, F.lower), " "))
    return match_ocr_tolerant(joined, "__labels", terms).drop("__labels")


def _lines_of_page(words: list[str], x: np.ndarray, y: np.ndarray, h: np.ndarray) -> list[str]:
    """Lines of one page of words by (y, x): a new row where y leaves the running mean of the row."""
    heights = np.sort(h[h > 0])
    if len(heights):
        height = heights[len(heights) // 2]
    else:  # guessed from the gaps between the distinct places of words
        gaps = np.sort(np.diff(np.unique(y[~np.isnan(y)].round(1))))
        height = 0.7 * gaps[len(gaps) // 2] if len(gaps) else 20.0
    slack = max(8.0, 0.65 * float(height))
    row, mean, held = [], 0.0, 0
    at = -1
    for v in y.tolist():
        if held and abs(v - mean) <= slack:
            mean, held = (mean * held + v) / (held + 1), held + 1
        else:
            at += 1
            mean, held = v, 1
        row.append(at)
    row = np.array(row)
    order = np.lexsort((x, row)).tolist()
    ends = np.cumsum(np.bincount(row)).tolist()
    words = [words[i] for i in order]
    return [" ".join(words[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


LINE_SCHEMA = pa.schema({"page_id": pa.int64(), "line_no": pa.int32(), "line": pa.string()})


def _pages(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of pages whose words come one page after another; a page may go on in the next batch."""
    def lines(table: pa.Table) -> pa.RecordBatch:
        words = [(t or "").strip() for t in table.column("t").to_pylist()]
        inked = np.flatnonzero([t != "" for t in words])
        page, (x, y, h) = table.column("page_id").combine_chunks(), (table.column(c).cast(pa.float64()).to_numpy() for c in "xyh")
        known = page.is_valid().to_numpy(zero_copy_only=False)[inked]
        ids = page.fill_null(0).to_numpy()[inked]
        order = np.lexsort((x[inked], y[inked], ids, known))
        inked, ids, known = inked[order], ids[order], known[order]
        starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])]).tolist() if len(ids) else []
        pages, numbers, out = [], [], []
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            own = inked[a:b]
            found = _lines_of_page([words[i] for i in own.tolist()], x[own], y[own], h[own])
            pages += [int(ids[a]) if known[a] else None] * len(found)
            numbers += range(1, len(found) + 1)
            out += found
        return pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(numbers, pa.int32()), pa.array(out, pa.string())], schema=LINE_SCHEMA)

    held: list[pa.Table] = []
    for batch in parts:
        if not batch.num_rows:
            continue
        page, last = batch.column("page_id"), batch.column("page_id")[-1].as_py()
        if held and held[-1].column("page_id")[-1].as_py() == last and page[0].as_py() == last:
            held.append(pa.Table.from_batches([batch]))
            continue
        same = (pc.equal(page, last) if last is not None else page.is_null()).fill_null(False).to_numpy(zero_copy_only=False)
        begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        whole = pa.concat_tables([*held, pa.Table.from_batches([batch.slice(0, begin)])])
        held = [pa.Table.from_batches([batch.slice(begin)])]
        if whole.num_rows:
            yield lines(whole)
    if held:
        yield lines(pa.concat_tables(held))


def reading_order(words: DataFrame) -> DataFrame:
    """page_id, line_no, line of word boxes (page_id, t, x, y, w, h). Words are dealt by page and cross to Python in batches of many pages; a page's words must fit in memory."""
    narrow = words.select(F.col("page_id").cast("long").alias("page_id"), "t", "x", "y", "h")
    dealt = narrow.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id").sortWithinPartitions("page_id")
    return dealt.mapInArrow(_pages, "page_id long, line_no int, line string")


#: The signs that Unicode counts as white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_WHITE = np.array([ord(c) for c in WHITE], np.uint32)


def _reflowed(text: str) -> str:
    """A text set one letter a line put back into words, by the places of its line breaks; other text as it is."""
    codes = np.frombuffer(text.replace("\r\n", "\n").replace("\r", "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(codes == 10)
    lines = len(breaks) + 1
    if lines < 4:
        return text
    inked = np.flatnonzero(~np.isin(codes, _WHITE))
    line = np.searchsorted(breaks, inked)
    first, last = np.zeros(lines, np.int64), np.full(lines, -1)
    first[line[::-1]], last[line] = inked[::-1], inked
    length = np.where(last >= 0, last - first + 1, 0)
    full = np.count_nonzero(length)
    if full < 4 or np.count_nonzero((length > 0) & (length <= 2)) < 0.55 * full:
        return text
    at = np.arange(len(codes))
    own = np.searchsorted(breaks, at)
    keep = (at >= first[own]) & (at <= last[own])
    keep[breaks] = (length[:-1] != 1) | (length[1:] != 1)  # single letters lean on the line before them
    out = codes[keep]
    gaps = np.flatnonzero(out == 10)
    begins = np.maximum.accumulate(np.where(np.diff(gaps, prepend=-2) > 1, np.arange(len(gaps)), 0))
    out = np.delete(out, gaps[np.arange(len(gaps)) - begins > 1])
    return out.tobytes().decode("utf-32-le", "surrogatepass").strip(WHITE) or text


@F.arrow_udf(StringType())
def _reflow(texts: pa.Array) -> pa.Array:
    return pa.array([_reflowed(t) if t else "" for t in texts.to_pylist()], pa.string())


def reflow_vertical(text: Column) -> Column:
    """Text set one letter a line put back into words; other text is left as it is, null is empty."""
    return _reflow(text)


def dedupe_lines(docs: DataFrame, doc: str, text_col: str = "text") -> DataFrame:
    """doc, text: lines collapsed, without those whose folded form, or its reverse, stood before; runs of empty lines are one."""
    lines = docs.select(doc, F.posexplode(F.split(text_col, r"\r\n|\n|\r")).alias("pos", "line")).withColumn("line", collapse_ws(F.col("line")))
    sign = ocr_fold(F.col("line"))
    keyed = lines.withColumn("key", F.least(sign, F.reverse(sign)))
    first = F.row_number().over(Window.partitionBy(doc, "key").orderBy("pos"))
    kept = keyed.withColumn("turn", F.when(F.col("key") == "", 1).otherwise(first)).where("turn = 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy(doc).agg(strip_ws(F.regexp_replace(text, "\n{3,}", "\n\n")).alias("text"))


TOKENS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+")
LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9]")
NO_SIGN = re.compile(r"[^\w\n]|_")
LEAST_TOKEN = 4
HINT_SLACK = 3  # letters that a token may have more or less than a hint
TOKEN_PORTION = 1 << 19  # signs of texts whose tokens are matched at once


def _hint_matcher(hints: list[str]) -> Callable[[list[str]], dict[str, str]]:
    """Of many tokens, those of LEAST_TOKEN or more folded letters that a hint is, as it stands, reversed, or with errors, with the first such hint."""
    from ..functions.text import ACCENTED, CONFUSED, PLAIN

    table = str.maketrans(ACCENTED + "".join(CONFUSED), PLAIN + "".join(CONFUSED.values()))

    def fold(tokens: list[str]) -> list[str]:
        return NO_SIGN.sub("", "\n".join(tokens).lower().translate(table)).split("\n") if tokens else []

    folded = [(f, h) for f, h in ((fold([h])[0], h) for h in hints) if len(f) >= LEAST_TOKEN]

    def match(tokens: list[str]) -> dict[str, str]:
        tokens = [*filter(str.isascii, tokens), *(t for t in tokens if not t.isascii())]  # a string of ASCII alone is translated much faster
        plain = sum(map(str.isascii, tokens))
        signs = fold(tokens[:plain]) + fold(tokens[plain:])
        found: dict[str, str] = {}
        for f, hint in folded:
            same = {f, f[::-1]}
            hits = [k for k in words_nearly(signs, f) if abs(len(signs[k]) - len(f)) <= HINT_SLACK] + [k for k, s in enumerate(signs) if s in same]
            for k in hits:
                if len(signs[k]) >= LEAST_TOKEN:
                    found.setdefault(tokens[k], hint)
        return found

    match.reach = max((len(f) for f, _ in folded), default=0) + HINT_SLACK
    return match


def repair_tokens(docs: DataFrame, doc: str, hints: list[str], text_col: str = "text") -> DataFrame:
    """doc, text: tokens of 4 or more folded letters that match a hint, or else do so glued to the next token with white space between, become the hint in the token's case. A next token that matches by itself is not glued. All other signs stay as they are; null text is empty.

    The distinct tokens and pairs of a portion of texts are matched at once.
    """

    def styled(hint: str, token: str) -> str:
        return hint.upper() if token.isupper() else hint.capitalize() if token[:1].isupper() and token[1:].islower() else hint.lower()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _hint_matcher(hints)

        def mended(tokens: list[str], found: dict[str, str]) -> str:
            out, i = [], 0
            while i < len(tokens):
                step, hint = 1, found.get(tokens[i]) if tokens[i].isalnum() else None
                if not hint and tokens[i].isalnum() and i + 2 < len(tokens) and tokens[i + 1].strip() == "" and "\n" not in tokens[i + 1] and tokens[i + 2] not in found:
                    hint = found.get(tokens[i] + tokens[i + 2])
                    step = 3 if hint else 1
                out.append(styled(hint, tokens[i]) if hint else tokens[i])
                i += step
            return "".join(out)

        def portion(texts: list[str]) -> list[str]:
            split = [TOKENS.findall(t) for t in texts]
            pairs = ((t, t[0 if LETTER.match(t[0]) else 1 :: 2] if t else t) for t in split)  # every other token is of letters or digits
            words = [[*t, *map(str.__add__, own, own[1:])] for t, own in pairs]
            asked = [w for w in set().union(*words) if LEAST_TOKEN <= len(w) <= match.reach and w.isalnum()]
            found = match(asked)
            return [t if found.keys().isdisjoint(w) else mended(own, found) for t, own, w in zip(texts, split, words, strict=True)]

        for batch in parts:
            out, held, size = [], [], 0
            for text in batch.column(1):
                text = text.as_py() or ""
                held.append(text)
                size += len(text)
                if size > TOKEN_PORTION:
                    out += portion(held)
                    held, size = [], 0
            out += portion(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [doc, "text"])

    return docs.select(doc, F.col(text_col).alias("text")).mapInArrow(run, f"{doc} {docs.schema[doc].dataType.simpleString()}, text string")


def candidate_score(text: Column, hit: Column) -> Column:
    """Letters weighed by their share among letters and other signs (digits and white space count as neither), words of two or more signs (at most 80), a bonus for hints; under 3 letters -0.5."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    other = F.regexp_count(text, F.lit(r"(?U)[^\p{L}\p{Nd}\s]"))
    words = F.least(F.lit(80), F.regexp_count(text, F.lit(r"(?U)\S{2,}")))
    score = letters * letters / F.greatest(letters + other, F.lit(1)) + 2 * words + F.when(hit, 500.0).otherwise(0.0)
    return F.when(letters < 3, -0.5).otherwise(score)


def best_candidate(candidates: DataFrame, item: str, hints: list[str], text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """item, text, score: the best of an item's candidates, or all of them joined if that scores higher or alone holds the hints.

    Candidates come in the order of `order_col` (else of the text). One that is
    in an earlier one, or is an earlier one with little more (up to a quarter, or
    12 characters in all), goes; one that holds an earlier one takes its place.
    An item's candidates are a handful of readings of one picture; they are
    folded as one array, without pairs. Empty candidates do not count.
    """
    order = F.col(order_col) if order_col else F.col(text_col)
    rows = candidates.select(item, order.alias("no"), F.regexp_replace(text_col, r"(?U)^\s+|\s+$", "").alias("text")).where("text <> ''")
    rows = rows.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("no", "text", F.lower(collapse_ws(F.col("text"))).alias("flat")))).alias("all"))
    size = F.char_length

    def covered(a: Column, b: Column) -> Column:
        return F.contains(b["flat"], a["flat"]) | (F.contains(a["flat"], b["flat"]) & (size(a["flat"]) <= F.greatest(F.lit(12), F.floor(size(b["flat"]) * 1.25).cast("int"))))

    def add(kept: Column, c: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda u: covered(c, u) | covered(u, c)), F.lit(True)).cast("int")
        u = F.get(kept, at - 1)
        return F.when(at == 0, F.concat(kept, F.array(c))).when(covered(c, u), kept).otherwise(F.transform(kept, lambda x, i: F.when(i == at - 1, c).otherwise(x)))

    kept = F.aggregate("all", F.slice("all", 1, 0), add)
    rows = rows.withColumn("kept", F.transform(kept, lambda c: c["text"]))

    def hit(text: Column) -> Column:
        return match_ocr_exactly(F.concat_ws("\n", text, F.reverse(text)), hints) if hints else F.lit(False)

    ranked = F.transform("kept", lambda t, i: F.struct(candidate_score(t, hit(t)).alias("score"), (-i).alias("i"), t.alias("text")))
    rows = rows.select(item, F.size("kept").alias("n"), F.array_max(ranked).alias("best"), F.array_join("kept", "\n").alias("joined"))
    rows = rows.withColumn("score", candidate_score(F.col("joined"), hit(F.col("joined"))))
    alone = hit(F.col("joined")) & ~hit(F.col("best.text"))
    whole = (F.col("n") > 1) & (alone | (F.col("score") > F.col("best.score")))
    return rows.select(item, F.when(whole, F.col("joined")).otherwise(F.col("best.text")).alias("text"), F.when(whole, F.col("score")).otherwise(F.col("best.score")).alias("score"))
