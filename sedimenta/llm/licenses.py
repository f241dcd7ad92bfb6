"""License scans by conditional compression.

Candidates are the places of a text that share `RUN` successive words with a template, found by hashes over all of its words. Their surroundings are
compressed with each template as a raw zstandard dictionary; the templates are ranked by how small they make them. The best ones are then aligned word by word with
as much text around the place as each needs, and one is confirmed if hardly a word differs, and none that tells licences apart.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from sedimenta.llm.common import quoted
from sedimenta.llm.templates import RESERVED, TEMPLATES
from sedimenta.llm.textkit import mix, spans, string_buffers, words

RUN = 3  # words in a row that a place has in common with a template to be a candidate; a shorter template counts whole
LEVEL = 3
CONTENDERS = 4  # templates that are aligned; any that ties with the last of them as well
TOLERANCE = 0.1
SHORT = 40  # words of a notice that must have every telling word
AROUND = (0, 120, 600)  # characters on both sides of a candidate that are compressed, wherever lines end
GAP = 300  # candidates that no template confirms share a row where no more characters lie between them
CHARS = 24  # characters that a word takes at most on the average, with what stands between words
_WORDS = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W\d_]+")
_RESERVED = re.compile(r"\W+".join(RESERVED[1].rstrip(".").split()), re.IGNORECASE)


def wording(text: str) -> list[str]:
    """Lower-case words and version numbers; a version's trailing ".0" counts."""
    return _WORDS.findall(text.lower())


def hashed_runs(h: np.ndarray, first: np.ndarray, run: int) -> np.ndarray:
    """A hash of each word and the run - 1 words after it in its row; 0 where the row has fewer."""
    out = h[: max(0, len(h) - run + 1)].copy()
    for k in range(1, run):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    out = np.concatenate([out, np.zeros(len(h) - len(out), np.uint64)])
    return np.where(np.arange(len(h)) + run <= np.repeat(first[1:], np.diff(first)), out, np.uint64(0))


class Gate:
    """Finds the stretches of texts that are runs of words of some wording."""

    def __init__(self, wordings: list[str]) -> None:
        self.known: dict[int, np.ndarray] = {}
        for text in wordings:
            raw = np.frombuffer(text.encode(), np.uint8)
            _, _, h, first = words(raw, np.array([0, len(raw)]))
            run = min(RUN, len(h))
            if run:
                got = hashed_runs(h, first, run)
                self.known[run] = np.union1d(self.known.get(run, got[:0]), got[got != 0])

    def places(self, data: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Row -> byte ranges of its stretches, in order; runs that overlap are one stretch."""
        starts, ends, h, first = words(data, offs)
        hit = np.zeros(len(h), np.int64)
        for run, known in self.known.items():
            got = hashed_runs(h, first, run)
            near = np.zeros(1 << 16, bool)
            near[(known >> np.uint64(48)).astype(np.int64)] = True
            at = np.flatnonzero(near[(got >> np.uint64(48)).astype(np.int64)])
            at = at[np.isin(got[at], known)]
            hit[at] = np.maximum(hit[at], run)
        out: dict[int, list[tuple[int, int]]] = {}
        for w in np.flatnonzero(hit):
            row = int(np.searchsorted(first, w, side="right")) - 1
            begin, end = int(starts[w] - offs[row]), int(ends[w + hit[w] - 1] - offs[row])
            held = out.setdefault(row, [])
            if held and begin <= held[-1][1]:
                held[-1] = (held[-1][0], max(end, held[-1][1]))
            else:
                held.append((begin, end))
        return out


def in_characters(text: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of a text as ranges of characters."""
    if text.isascii():
        return places
    raw = np.frombuffer(text.encode(), np.uint8)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(before[a]), int(before[b])) for a, b in places]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] | None = None) -> None:
        self.templates = TEMPLATES if templates is None else templates
        self.words = [wording(t) for _, t in self.templates]
        self.gate = Gate([t for _, t in [*self.templates, RESERVED]])
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        *self.primed, self.reserved = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in [*self.templates, RESERVED]
        ]
        #: words in which some template differs from another: names, numbers, clauses
        everywhere = set.intersection(*[set(w) for w in self.words]) if self.words else set()
        generic = {"licensed", "released", "distributed", "this", "work", "project", "is", "under", "the", "a", "license", "licence", "of", "by", "at", "or", "and", "in", "you", "may", "file", "http", "https", "www"}
        self.telling = {w for ws in self.words for w in ws} - generic - everywhere
        self.short = {t: self.telling.intersection(ws) for t, ws in enumerate(self.words) if len(ws) < SHORT}

    def scan(self, block: str) -> tuple[str, bool, float, float, list[str], list[str], int] | None:
        """(licence, confirmed, size reduction, share of the template's words found, words missing, words extra, words matched)."""
        raw = " ".join(block.lower().split()).encode()
        mine = wording(block)
        if not raw or not self.templates:
            return None
        alone = len(self.plain.compress(raw))
        size = np.array([len(c.compress(raw)) for c in self.primed])
        order = np.argsort(size, kind="stable")
        last = size[order[min(CONTENDERS, len(order)) - 1]]
        best = None
        for t in order[size[order] <= last]:
            missing, extra = self.differences(self.words[t], mine)
            telling = [w for w in [*missing, *extra] if w in self.telling]
            confirmed = self.confirmed(t, missing, extra)
            key = (not confirmed, len(missing) + len(extra), len(telling), int(size[t]), int(t))
            if best is None or key < best[0]:
                best = (key, t, missing, extra, confirmed)
        _, t, missing, extra, confirmed = best
        if not confirmed and _RESERVED.search(block):
            with_it = len(self.reserved.compress(raw))
            return RESERVED[0], False, round(float(1 - with_it / alone), 6), 1.0, [], [], len(wording(RESERVED[1]))
        found = 1 - len(missing) / max(1, len(self.words[t]))
        return self.templates[t][0], confirmed, round(float(1 - size[t] / alone), 6), round(found, 6), missing, extra, len(self.words[t]) - len(missing)

    def rank(self, block: str) -> list[int]:
        """The templates that make the block smallest when they are its dictionary."""
        raw = " ".join(block.lower().split()).encode()
        size = np.array([len(c.compress(raw)) for c in self.primed])
        last = np.sort(size)[min(CONTENDERS, len(size)) - 1]
        return np.flatnonzero(size <= last).tolist()

    def notice(self, text: str, begin: int, end: int, lo: int) -> tuple[int, int, int, list[str], list[str]] | None:
        """(start, end, template, words missing, words extra) of the confirmed notice around the candidate [begin, end), not before `lo`. The contenders are
        ranked by the candidate and by more and more of what stands around it, which tells short notices amid other text too little apart: those
        whose telling words all stand around it contend as well. Each is aligned with as many words before and after it as it has itself."""
        contenders = {t for n in AROUND for t in self.rank(text[max(lo, begin - n) : end + n])}
        reach = CHARS * max(SHORT, *(len(self.words[t]) for t in contenders)) + AROUND[1]
        at = max(lo, begin - reach)
        tokens = [(m.start() + at, m.end() + at, m.group().lower()) for m in _WORDS.finditer(text[at : end + reach])]
        here, there = sum(e <= begin for _, e, _ in tokens), sum(b < end for b, _, _ in tokens)
        close = {w for _, _, w in tokens[max(0, here - 2 * SHORT) : there + 2 * SHORT]}
        contenders |= {t for t, named in self.short.items() if named <= close}
        best = None
        for t in sorted(contenders):
            n = len(self.words[t])
            slack = 3 + int(TOLERANCE * n)
            low = max(0, here - n - slack)
            mine = [w for _, _, w in tokens[low : there + n + slack]]
            if n - (Counter(self.words[t]) & Counter(mine)).total() > TOLERANCE * n:
                continue
            for a, b, missing, extra in self.alignments(self.words[t], mine, slack):
                if tokens[low + a][0] >= end or tokens[low + b - 1][1] <= begin or not self.confirmed(t, missing, extra):
                    continue
                key = (n - 2 * len(missing) - len(extra), -t)
                if best is None or key > best[0]:
                    best = key, (tokens[low + a][0], tokens[low + b - 1][1], t, missing, extra)
                break
        return best and best[1]

    def confirmed(self, t: int, missing: list[str], extra: list[str]) -> bool:
        return len(missing) <= TOLERANCE * len(self.words[t]) and not (len(self.words[t]) < SHORT and any(w in self.telling for w in [*missing, *extra]))

    @staticmethod
    def alignments(template: list[str], block: list[str], slack: int):
        """(first, end, words missing, words extra) of the template in the block, trimmed to the run of equal words that outweighs the words between
        them most: first where the longest equal run puts it, then anywhere."""
        whole = SequenceMatcher(None, template, block, autojunk=False)
        a, b, size = whole.find_longest_match(0, len(template), 0, len(block))
        low = max(0, b - a - slack)
        for at, part in ((low, block[low : b - a + len(template) + slack]), (0, block)):
            best, run, score, end = (0, []), [], 0, 0
            for i, j, n in SequenceMatcher(None, template, part, autojunk=False).get_matching_blocks()[:-1]:
                score -= j - end
                if score <= 0:
                    run, score = [], 0
                run, score, end = [*run, (i, j, n)], score + n, j + n
                if score > best[0]:
                    best = score, run
            run = best[1]
            if run:
                same = {k for i, _, n in run for k in range(i, i + n)}
                missing = [w for k, w in enumerate(template) if k not in same]
                extra = [w for (_, j, n), (_, after, _) in zip(run, run[1:]) for w in part[j + n : after]]
                yield at + run[0][1], at + run[-1][1] + run[-1][2], missing, extra

    def scan_all(self, text: str, places: list[tuple[int, int]] | None = None) -> list[tuple]:
        """(start, block, licence, confirmed, size reduction, share of words found, words missing, words extra) of a text's notices and of the
        candidates that belong to none; the candidates are character ranges."""
        if places is None:
            raw = np.frombuffer(text.encode(), np.uint8)
            places = in_characters(text, self.gate.places(raw, np.array([0, len(raw)])).get(0, []))
        out, loose, lo = [], [], 0
        for begin, end in places:
            begin = max(begin, lo)
            while begin < end:  # a stretch may hold several notices
                got = self.notice(text, begin, end, lo) if self.templates else None
                if got is None:
                    if loose and begin - loose[-1][1] <= GAP:
                        loose[-1][1] = end
                    else:
                        loose.append([begin, end])
                    break
                first, last, t, missing, extra = got
                last = re.compile(r"[^\w\s]*").match(text, last).end()  # its own full stop
                raw = " ".join(text[first:last].lower().split()).encode()
                out += self.candidates(text, loose, lo, first)
                out.append((first, text[first:last], self.templates[t][0], True, round(1 - len(self.primed[t].compress(raw)) / len(self.plain.compress(raw)), 6), round(1 - len(missing) / len(self.words[t]), 6), missing, extra))
                loose, lo = [], last
                begin = max(begin, last)
        return out + self.candidates(text, loose, lo, len(text))

    def candidates(self, text: str, loose: list[list[int]], lo: int, before: int) -> list[tuple]:
        """Rows of candidates that no template confirms, with what stands close to them, between `lo` and `before`."""
        out = []
        for begin, end in loose:
            if begin < before:
                first, last = max(lo, begin - AROUND[1]), min(before, end + AROUND[1])
                if (got := self.scan(text[first:last])) is not None:
                    out.append((first, text[first:last], *got[:6]))
                lo = last
        return out

    @staticmethod
    def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
        """Words of the template that the block lacks, and words that the block has between the first and
        the last word that match; what stands before and after isn't part of the notice."""
        ops = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
        same = [k for k, op in enumerate(ops) if op[0] == "equal"]
        missing = [w for kind, a, b, _, _ in ops if kind != "equal" for w in template[a:b]]
        if not same:
            return missing, []
        extra = [w for kind, _, _, a, b in ops[same[0] : same[-1] + 1] if kind != "equal" for w in block[a:b]]
        return missing, extra


def license_scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, block_no, start, block, license, confirmed, reduction, found, missing, extra): one row a notice, and one for each place that shares `RUN`
    successive words with a template but is confirmed by none (such places at most `GAP` characters apart are one).

    Neighbouring notices get a row each; where lines end doesn't matter. `license` is the template that fits best, `confirmed` whether its wording is there: at most a tenth of its words
    missing, and in a short notice no word that tells licences apart missing or put in. Ties go to the fewest differing words, then the smaller size, then the
    order of the templates. Where no template is confirmed but all rights are reserved, `license` says so; that grants nothing, so it isn't confirmed. `start` counts characters. A text that shares no such run with a template, a null or empty one too, has no row. Each row is scanned on its own, so repeated
    rows and null ids repeat theirs; texts are scanned whole, however long. An empty table gives an empty table; further columns aren't read.
    """
    docs = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            rows, column = [], batch.column(1)
            data, offs = string_buffers(column)
            for lo, hi in spans(offs):
                for row, places in sorted(scanner.gate.places(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]).items()):
                    text = column[lo + row].as_py()
                    rows += [(lo + row, no, *found) for no, found in enumerate(scanner.scan_all(text, in_characters(text, places)))]
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(c[0])), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], pa.string()), pa.array(c[5], pa.bool_()), pa.array(c[6], pa.float64()), pa.array(c[7], pa.float64()), pa.array(c[8], pa.list_(pa.string())), pa.array(c[9], pa.list_(pa.string()))],
                    ["doc_id", "block_no", "start", "block", "license", "confirmed", "reduction", "found", "missing", "extra"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, block_no int, start bigint, block string, license string, confirmed boolean, reduction double, found double, missing array<string>, extra array<string>"
    return docs.mapInArrow(run, schema)
