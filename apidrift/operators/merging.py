"""Lay the edits of a text over its tokens, in one pass over either.

Does within the row of a file what ``file_edits`` and ``stitch`` do by windows and groups over the rows of edits
(kinds of edits: ``entities``): edits within a removed range are left out, those of a position become one
segment, and the segments replace tokens. All that does not meet an edit stays byte for byte.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

EDIT_FIELDS = ("k", "pos", "end", "o", "m", "c", "txt", "src")
DONE = "struct<code:string,hits:array<struct<o:int,m:int,c:boolean>>>"


def merger() -> Callable:
    """A function of line end, trivia, tokens and edits (tuples of ``EDIT_FIELDS``) that gives the new text and its hits.

    It holds all it needs, so that workers need no module of this package.
    """
    rank = {"x": 0, "r": 0, "T": 1}

    def order(edit):
        return edit[1], rank.get(edit[0], 2), float("inf") if edit[2] is None else -edit[2]

    def kept(edits):
        """The edits that count, by position, and whether a removed range covers them."""
        reach = last = None
        around = []
        for edit in sorted(edits, key=order):
            k, pos, end, o = edit[:4]
            covered = reach is not None and reach >= pos
            if k == "x" or k == "r":
                if not covered:
                    around = []
                around.append((end, o))
                reach = end if reach is None or end > reach else reach
            elif k == "T":
                last = pos
            elif k == "h" and last == pos:
                continue
            # A covered hit counts only if it came before every removal around it.
            elif covered and k in ("h", "H", "z", "D") and any(e >= pos and by < o for e, by in around):
                continue
            yield edit, covered

    def cut(text):
        """Length of the first line with its end."""
        ends = [at for at in (text.find("\r"), text.find("\n")) if at >= 0]
        if not ends:
            return len(text)
        return min(ends) + (2 if text.startswith("\r\n", min(ends)) else 1)

    def merged(nl, pres, toks, edits):
        out = [pre + tok for pre, tok in zip(pres, toks)]
        hits, layouts = [], []
        at = None
        rows = [*kept(edits), (None, None)]
        best, noted, marks, inserts, layout, stop, there = {}, [], {}, set(), None, None, set()
        for edit, covered in rows:
            pos = None if edit is None else edit[1]
            if pos != at and at is not None:
                hits += noted
                hits += marks
                tok = best.get("r", best.get("T", best.get("t")))
                before = "".join(txt for _, txt in sorted(inserts))
                deco, first, after = best.get("g"), best.get("w"), best.get("a")
                cut_line, cut_indent = "l" in there, "d" in there
                if "x" in there:
                    out[at] = ""
                elif tok is not None or before or cut_line or cut_indent or best:
                    pre = best.get("q", pres[at])
                    if deco is not None:
                        n = cut(pres[at])
                        pre = pres[at][:n] + (deco if nl == "\n" else deco.replace("\n", nl)) + pres[at][n:]
                    if cut_line:
                        pre = pre[cut(pre):]
                    if cut_indent:
                        pre = pre[:max(pre.rfind("\n"), pre.rfind("\r")) + 1]
                    out[at] = "".join((
                        first or "", pre, before if nl == "\n" else before.replace("\n", nl),
                        "" if cut_indent else toks[at] if tok is None else tok, after or ""))
                if stop is not None:
                    out[at + 1:stop + 1] = [""] * (stop - at)
                if layout is not None:
                    layouts.append((at, *layout))
                best, noted, marks, inserts, layout, stop, there = {}, [], {}, set(), None, None, set()
            if edit is None:
                break
            at = pos
            k, _, end, o, m, c, txt, src = edit
            if k in ("h", "H", "z"):
                noted.append((o, m, c, txt, src))
            elif k == "D":
                marks[o, m, c, txt, None] = None
            if covered:
                continue
            if k == "b":
                inserts.add((o, txt))
            elif k == "S":
                layout = (end, src) if layout is None else max(layout, (end, src))
            elif k in ("x", "l", "d"):
                there.add(k)
            elif k not in ("h", "H", "z", "D") and txt is not None and (k not in best or txt > best[k]):
                best[k] = txt
            if k == "x" or k == "r":
                stop = end if stop is None else max(stop, end)
        if layouts:
            places, reached = [], -1
            for start, end, src in sorted(layouts):
                places += [None] * (start - reached - 1) + src
                reached = end
            places += [None] * (len(out) - len(places))
            out = [out[i if j is None else j] for i, j in zip(range(len(out)), places)]

        def differs(txt, src):
            if src is None or txt is None:
                return None
            a, b = src
            span = range(a, b + 1) if a <= b else range(a, b - 1, -1)
            return "".join(toks[i] if i == a else pres[i] + toks[i] for i in span).strip(" ") != txt

        return "".join(out), [(o, m, differs(txt, src) if c is None else c) for o, m, c, txt, src in hits]

    return merged


def merged_texts() -> Callable[..., Column]:
    """Column function: ``DONE`` from line end, text, the lengths of its trivia and tokens (``reading.READ``) and edits;
    null where there are no edits.

    Not deterministic in the eyes of the optimizer, so that it is never evaluated twice.
    """
    merged, names = merger(), EDIT_FIELDS

    @F.arrow_udf(DONE)
    def merge(nl: pa.Array, content: pa.Array, cuts: pa.Array, edits: pa.Array) -> pa.Array:
        codes, ends, hits, first = [], [0], [], 0
        held = edits.flatten()
        k, pos, end, o, m, c, txt, src = (held.field(i) for i in range(len(names)))
        sizes = pc.fill_null(pc.list_value_length(edits), 0).to_pylist()
        for line, text, lengths, size in zip(nl, content, cuts, sizes):
            if size:
                part = lambda column: column.slice(first, size)
                rows = zip(
                    part(k).to_pylist(), part(pos).to_pylist(), part(end).to_pylist(), part(o).to_pylist(), part(m).to_pylist(),
                    part(c).to_pylist(), part(txt).to_pylist(),
                    [None] * size if part(src).null_count == size else part(src).to_pylist())
                text, places, at = text.as_py(), [0], 0
                for length in array("I", lengths.as_py()):
                    at += length
                    places.append(at)
                pieces = [text[a:b] for a, b in zip(places, places[1:])]
                code, found = merged(line.as_py(), pieces[::2], pieces[1::2], rows)
                codes.append(code)
                hits += found
            else:
                codes.append(None)
            ends.append(len(hits))
            first += size
        columns = [*zip(*hits)] or [()] * 3
        of = pa.StructArray.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.bool_()))], ["o", "m", "c"])
        return pa.StructArray.from_arrays(
            [pa.array(codes, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of)], ["code", "hits"])

    return merge.asNondeterministic()
