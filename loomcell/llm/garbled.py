"""Text decoded with the wrong encoding: found by precomputed garbled sequences.

For every pair of encodings (written in, read as) the sequences that characters of
the expected repertoire turn into are worked out once and put into one multi-pattern
automaton. Pairs of single-byte encodings turn one character into one other, which
may look correct: all of them are tried, and the likelihood of the two-character
sequences in the corpus decides. Only matched spans are replaced, so correct text
around them, foreign letters, symbols and drawing characters included, stays as it
is. Restoring is repeated until nothing changes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import suppress
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcell.runtime import ship

#: Encodings as which UTF-8 bytes are read, one byte a character.
UTF8_READ_AS = ("cp1252", "latin_1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "iso8859_2", "cp866", "iso8859_5", "mac_cyrillic")
#: Double-byte encodings whose bytes are read one byte a character.
DOUBLE_BYTE, READ_AS = ("gb18030", "big5"), ("cp1252", "latin_1")
#: Those as which UTF-8 bytes are read, two bytes a character.
UTF8_AS_DOUBLE = ("gb18030", "cp932", "cp949", "big5")
_REREAD = tuple(f"utf_8>{e}" for e in UTF8_AS_DOUBLE)
#: Double-byte encodings read as another one.
DOUBLE_AS_DOUBLE = (("big5", "gb18030"), ("gb18030", "big5"))

_PUNCTUATION = "–—‘’‚“”„†‡•…‰‹›€™№−√≤≥≠≈∞∑∂π⁄"
#: Characters that may follow a capital letter or a dash in correct text.
_MAY_FOLLOW = frozenset("“”„‘’‚–—…«»№\xa0‹›™®")
#: A run of adjacent matches of this length is needed where one match proves nothing.
_RUN_WEAK, _RUN_DOUBLE, _RUN_AS_DOUBLE, _RUN_WORD = 2, 3, 4, 5


def _read(data: bytes, encoding: str) -> str:
    """Bytes as the encoding reads them; a single byte it lacks is a control."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return "".join(_byte(b, encoding) for b in data)


def _byte(b: int, encoding: str) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


@cache
def common_han() -> frozenset[str]:
    """The frequently used ideographs: the first levels of GB 2312 and Big5."""
    gb = {bytes([r, c]).decode("gb2312", "ignore") for r in range(0xB0, 0xD8) for c in range(0xA1, 0xFF)}
    big = {bytes([r, c]).decode("big5", "ignore") for r in range(0xA4, 0xC7) for c in [*range(0x40, 0x7F), *range(0xA1, 0xFF)]}
    return frozenset(c for c in gb | big if len(c) == 1 and "一" <= c <= "鿿")


@cache
def letters() -> str:
    """Letters and signs of European texts that no ASCII byte stands for."""
    ranges = ((0xA0, 0x180), (0x391, 0x3CA), (0x401, 0x402), (0x410, 0x450), (0x451, 0x452), (0x2500, 0x2580))
    return "".join(chr(i) for a, b in ranges for i in range(a, b) if i != 0x3A2) + _PUNCTUATION


@cache
def asian() -> str:
    """Ideographs in use, their punctuation and the full-width forms."""
    return "".join(sorted(common_han())) + "".join(map(chr, [*range(0x3001, 0x3018), *range(0xFF01, 0xFF5F)]))


def _word_like(seq: str) -> bool:
    """Whether a sequence could be a piece of a Cyrillic word."""
    return all("а" <= c <= "я" or c == "ё" for c in seq[1:]) and ("А" <= seq[0] <= "я" or seq[0] in "ёЁ")


def _proves(seq: str, reader: str, original: str = "") -> bool:
    """Whether one sequence of read UTF-8 proves a wrong reading by itself."""
    a, b = seq[0], seq[1]
    if _word_like(seq) or "\x80" <= original < "\xa0":
        return False
    if len(seq) > 2 or a == "Â":
        return True
    if "─" <= b <= "╿" and "─" <= a <= "╿" or a in "─–—œŒ":
        return False
    if reader == "mac_roman" and not a.isalpha() and (b in "Ωπ∂∑∏∫∞±≤≥≠µ" or b.isspace()):
        return False
    if b in _MAY_FOLLOW:  # a capital before a quotation mark and the like, but none that ends words
        return a == "Ã" and b not in "“”„\xa0" or a == "Ă" or not a.isalpha()
    # two letters that stand in one alphabet's words
    if "А" <= a <= "я" and ("А" <= b <= "я" or b in "ёЁ"):
        return False
    if reader in ("koi8_r", "cp850") and a.isalpha() and b.isalpha():
        return False
    return True


#: start, end, pair, restored text
Span = tuple[int, int, str, str]
#: start, end, character before, characters, character after, number of the line
Run = tuple[int, int, str, str, str, int]
#: (pair, original, proves by itself, run needed otherwise)
Meaning = tuple[str, str, bool, int]


def sequences() -> Iterator[tuple[str, Meaning]]:
    """All garbled sequences with what they stand for."""
    for reader in UTF8_READ_AS:
        for c in [*letters(), *sorted((_repertoire() | set(map(chr, range(0x80, 0xA0)))) - set(letters())), *asian()]:
            seq = _read(c.encode(), reader)
            if len(seq) > 1:
                yield seq, (f"utf_8>{reader}", c, _proves(seq, reader, c), _RUN_WORD if _word_like(seq) else _RUN_WEAK)
    for writer in DOUBLE_BYTE:
        for c in asian():
            try:
                data = c.encode(writer)
            except UnicodeEncodeError:
                continue
            if len(data) != 2:
                continue
            for reader in READ_AS:
                yield _read(data, reader), (f"{writer}>{reader}", c, False, _RUN_DOUBLE)


def double_sequences() -> Iterator[tuple[str, Meaning]]:
    """Those of ideographs that look like other ideographs."""
    for writer, reader in DOUBLE_AS_DOUBLE:
        for c in asian():
            try:
                seq = c.encode(writer).decode(reader)
            except UnicodeError:
                continue
            if seq != c and not seq.isascii() and not any(x in letters() for x in seq):
                yield seq, (f"{writer}>{reader}", c, False, _RUN_AS_DOUBLE)
    # of UTF-8 read two bytes a character: the first two bytes of an ideograph
    for reader in UTF8_AS_DOUBLE:
        for lead in range(0xE3, 0xEA):
            for second in range(0x80, 0xC0):
                with suppress(UnicodeDecodeError):
                    seq = bytes([lead, second]).decode(reader)
                    if not seq.isascii():
                        yield seq, (f"utf_8>{reader}", "", False, _RUN_WEAK)


@cache
def automaton(double: bool) -> ahocorasick.Automaton:
    """Of the sequences that correct text hardly has, or of those of ideographs
    only, for texts with characters that no common text is made of."""
    a = ahocorasick.Automaton()
    meanings: dict[str, list[Meaning]] = {}
    for seq, m in double_sequences() if double else sequences():
        known = meanings.setdefault(seq, [])
        if all(m[0] != k[0] for k in known):
            known.append(m)
    for seq, ms in meanings.items():
        a.add_word(seq, (len(seq), tuple(ms)))
    a.make_automaton()
    return a


@cache
def _firsts(double: bool) -> frozenset[str]:
    return frozenset(seq[0] for seq, _ in (double_sequences() if double else sequences()))


@cache
def _usual() -> frozenset[str]:
    """Characters of common texts in ideographs."""
    return common_han() | frozenset(map(chr, [*range(0x80), *range(0x3000, 0x3018), *range(0xFF01, 0xFF5F)])) | frozenset(letters())


# ---- single-byte pairs: which restoring makes a text likelier


#: Single-byte encodings; every ordered pair of them is looked for.
SINGLE_BYTE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
#: Gain in log likelihood at which a stretch counts as read wrongly, and the least
#: gain of one run of characters that may start or end such a stretch.
GAIN, RUN_GAIN = 7.5, 0.5
#: Weights of a two-character sequence seen in another case, and of one never seen.
_OTHER_CASE, _NEVER_SEEN = 0.02, 0.2
_HAN, _OTHER, _DIGIT = "一", "�", "0"

#: A little correct text of several languages, so that the model knows their letters
#: whatever the corpus.
_SEED_TEXT = """Die Größe der Fläche überschreitet die Prüfung; für jede Änderung gibt es ähnliche Gründe. Übung, Ärger, Öl und Maß. „Schön“ heißt es früher – später fällt das Urteil zurück, gemäß der Größe.
La réserve vérifiée à côté de l’été; où la clé héritée désigne l’élève, le modèle français reçoit déjà très tôt la forêt. « Naïve », l’œuvre, ça, Noël, À bientôt, Écrire, être, même, hôtel, août, goût, tâche.
As versões da revisão são não só a razão; você têm opções e relações, também é preciso à média. Ações, início, válido, análise, três, módulo, possível, até, já, só, público, próprio, através, será, está.
El niño pequeño mañana dirá cuándo; ¿qué pasó? ¡Así! La canción, él también, según, año, español, corazón, número, fácil, país.
Если оценка ниже порога, то рецензент считает запись новой и храним снимок. Мы сравниваем границу с прежней областью. Это было в первый день, когда весь объём работы ещё не был готов; подъезд, съёмка, чужой, щит, юг, якорь, цель, эхо, жизнь, фильм.
It’s the symbol that “decides” — don’t, we’ll, that’s, café, naïve, résumé… the team’s notes – and 20 °C, 5 µm, § 3, ± 2, £4, €5."""


@cache
def _repertoire() -> frozenset[str]:
    """All characters beyond ASCII that the single-byte encodings have."""
    return frozenset(c for e in SINGLE_BYTE for b in range(128, 256) if (c := _byte(b, e)).isprintable() and c != "\xad" or c == "\xa0")


@cache
def _single_letters() -> frozenset[str]:
    """Characters of double-byte encodings that two bytes of a European letter give."""
    return frozenset(g for _, inv in _inverses() for g in inv) - _repertoire()


@cache
def _runs() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(c) for c in sorted(_repertoire() | _single_letters())) + "]+")


@cache
def _known() -> frozenset[str]:
    return _repertoire() | _single_letters()


class _Classes(dict):
    """Characters as the model knows them: ideographs, digits, foreign ones by kind."""

    def __missing__(self, c: str) -> str:
        plain = chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c  # full-width forms read as their plain ones
        if plain.isascii() or plain.isspace() and plain != "\xa0":
            v = _DIGIT if plain.isdigit() else " " if plain.isspace() else plain
        else:
            v = c if c in _known() else _HAN if "⺀" <= c <= "鿿" else _OTHER
        self[c] = v
        return v


_CLASS = _Classes()


def pairs_in(texts: list[str], seen: dict[str, int] | None = None) -> dict[str, int]:
    """Counts of two-character sequences with a character beyond ASCII. There are no
    more of them than the square of the repertoire, whatever the texts."""
    seen = {} if seen is None else seen
    whole = "\n".join(["", *texts, ""])
    for m in _runs().finditer(whole):
        r = _CLASS[whole[m.start() - 1]] + m.group() + _CLASS[whole[m.end()]]
        for i in range(len(r) - 1):
            k = r[i : i + 2]
            seen[k] = seen.get(k, 0) + 1
    return seen


@cache
def _inverses() -> tuple[tuple[str, dict[str, str]], ...]:
    """(pair, what each character beyond ASCII read stands for) of all pairs."""
    out = []
    for writer in SINGLE_BYTE:
        for reader in SINGLE_BYTE:
            inv = {_byte(b, reader): _byte(b, writer) for b in range(128, 256)} if writer != reader else {}
            inv = {g: o for g, o in inv.items() if o in _repertoire()}
            if any(g != o for g, o in inv.items()):
                out.append((f"{writer}>{reader}", inv))
    for reader in UTF8_AS_DOUBLE:  # two bytes of a European letter that are one character
        inv = {}
        for c in letters():
            with suppress(UnicodeDecodeError):
                g = c.encode().decode(reader)
                if len(g) == 1:
                    inv[g] = c
        out.append((f"utf_8>{reader}", inv))
    return tuple(out)


def _runs_of(text: str) -> list[Run]:
    out, line, last, n = [], 0, 0, len(text)
    for m in _runs().finditer(text):
        a, b = m.span()
        line, last = line + text.count("\n", last, a), a
        out.append((a, b, _CLASS[text[a - 1]] if a else " ", m.group(), _CLASS[text[b]] if b < n else " ", line))
    return out


class Likelihood:
    """How usual a text's sequences of two characters are, by counts of a corpus."""

    def __init__(self, counts: dict[str, int] | None = None) -> None:
        self.n = pairs_in(_SEED_TEXT.split("\n"))
        for k, v in (counts or {}).items():
            self.n[k] = self.n.get(k, 0) + v
        self.folded: dict[str, int] = {}
        for k, v in self.n.items():
            f = k.lower()
            self.folded[f] = self.folded.get(f, 0) + v
        self._two: dict[str, float] = {}
        self._known: dict[str, tuple[tuple[int, str, float], ...]] = {}

    def _score(self, r: str) -> float:
        total = 0.0
        for i in range(len(r) - 1):
            k = r[i : i + 2]
            v = self._two.get(k)
            if v is None:
                inner = k[0].islower() and k[1].isupper()  # no other case excuses a capital inside a word
                n = self.n.get(k, 0) + (0 if inner else _OTHER_CASE * self.folded.get(k.lower(), 0)) + _NEVER_SEEN
                v = self._two[k] = 0.0 if _OTHER in k else math.log(n)  # beside a foreign or invisible character nothing is known
            total += v
        return total

    def score_between(self, text: str, a: int, b: int, new: str) -> float:
        """Log likelihood of the text with its characters from a to b replaced."""
        return self._score((_CLASS[text[a - 1]] if a else " ") + "".join([_CLASS[c] for c in new]) + (_CLASS[text[b]] if b < len(text) else " "))

    def better(self, before: str, run: str, after: str) -> tuple[tuple[int, float], ...]:
        """(number of the pair, gain) of the pairs whose restoring makes a run of
        characters between two others likelier."""
        key = before + run + after
        known = self._known.get(key)
        if known is None:
            if len(self._known) > 500_000:
                self._known.clear()
            old, out, made = self._score(key), [], {}
            for i, (_, inv) in enumerate(_inverses()):
                new = "".join([inv.get(c, "") for c in run])
                if len(new) == len(run):
                    if new not in made:
                        made[new] = self._score(before + new + after) - old
                    if made[new] > 0:
                        out.append((i, made[new]))
            known = self._known[key] = tuple(out)
        return known

    def restored(self, pair: int, before: str, run: str, after: str) -> tuple[str, float]:
        """(restored run, gain) by one pair; it gains nothing if it can't read it."""
        inv = _inverses()[pair][1]
        new = "".join([inv.get(c, "") for c in run])
        if len(new) != len(run):
            return run, -math.inf
        return new, self._score(before + new + after) - self._score(before + run + after)

    def stretches(self, runs: list[Run], taken: list[bool], least: float, writers: tuple[str, ...] = ()) -> list[Span]:
        """Stretches of a line that one pair's restoring makes much likelier: for
        each pair the runs of greatest total gain, of all pairs the best; then what
        is left of the line. Another pair's span or a line's end ends a stretch."""
        found: list[Span] = []
        lines: list[list[Run]] = []
        last: tuple[int, int] | None = None
        for n, r in enumerate(runs):
            if any(taken[r[0] : r[1]]):
                continue
            if last != (r[5], n - 1):
                lines.append([])
            lines[-1].append(r)
            last = (r[5], n)
        for todo in [[x] for x in lines]:
            while todo:
                part = todo.pop()
                best = self._best(part, least, writers)
                if best:
                    pair, lo, hi, new = best
                    found += [(part[i][0], part[i][1], _inverses()[pair][0], new[i - lo]) for i in range(lo, hi)]
                    todo += [x for x in (part[:lo], part[hi:]) if x]
        return found

    def _best(self, runs: list[Run], least: float, writers: tuple[str, ...]) -> tuple[int, int, int, list[str]] | None:
        """(pair, from, to, restored runs) of the greatest gain, if it is enough."""
        most: dict[int, float] = {}
        for r in runs:
            for pair, gain in self.better(*r[2:5]):
                most[pair] = most.get(pair, 0.0) + gain
        best = None
        for pair, top in sorted(most.items(), key=lambda x: (-x[1], x[0])):
            if top <= least:
                break
            if writers and not _inverses()[pair][0].startswith(writers):
                continue
            made = [self.restored(pair, *r[2:5]) for r in runs]
            total, start = 0.0, 0
            for i, (_, gain) in enumerate(made):
                if total <= 0:
                    total, start = 0.0, i
                total += gain
                if total > least and gain >= RUN_GAIN:
                    best, least = (pair, start, i + 1, [x[0] for x in made[start : i + 1]]), total
        return best


#: No text has these: controls of the second block (but the line break), private
#: use, and the mark of a byte that could not be read.
_NEVER = re.compile("[\x80-\x84\x86-\x9f-�]")

def _odd_han(text: str) -> bool:
    """Mostly characters that no common text is made of."""
    han = common_han()
    odd = sum(not (c in han or "　" <= c <= "】" or "！" <= c <= "～" or c.isascii()) for c in text)
    return odd * 5 >= len(text) * 2


def _reread(text: str, start: int, reader: str) -> tuple[int, str]:
    """(end, restored text) of UTF-8 read two bytes a character: as far as the bytes
    are UTF-8. What follows was never UTF-8 and stays; a byte lost in between is
    passed over if two whole characters follow it."""
    end, data, ends = start, bytearray(), []
    while end < len(text) and not text[end].isascii():
        data += b"\xff" if text[end] == "\ufffd" else text[end].encode(reader, "ignore")
        end += 1
        ends.append(len(data))
    out, at = [], 0

    def whole(i: int) -> int:
        """Length of the UTF-8 character at i, 0 if there is none."""
        n = 1 if data[i] < 0x80 else 2 if 0xC2 <= data[i] < 0xE0 else 3 if 0xE0 <= data[i] < 0xF0 else 0
        try:
            return n if n and len(data[i : i + n].decode()) == 1 else 0
        except UnicodeDecodeError:
            return 0

    while at < len(data):
        n = whole(at)
        if not n:
            # a cut character: its remains up to the next whole one
            cut = data[at:].find(0xFF)
            if 0xC2 <= data[at] < 0xF5 and cut in (1, 2) and (cut == 1 or data[at + 1] & 0xC0 == 0x80):
                out.append("\ufffd")
                at += cut + 1
                continue
            skip = next((k for k in range(1, 4) if at + k < len(data) and (m := whole(at + k)) and at + k + m < len(data) and whole(at + k + m)), 0)
            if not skip:
                break
            out.append("\ufffd")
            at += skip
            continue
        out.append(data[at : at + n].decode())
        at += n
    used = next((i for i, e in enumerate(ends) if e >= at), len(ends) - 1) + 1
    if at < ends[used - 1] or used < len(ends) and text[start + used] == "\ufffd":  # the last character was cut
        out.append("\ufffd")
        used += at == ends[used - 1]
    return start + used, "".join(out)


def _reread_spans(text: str, matches: list[tuple[int, int, tuple[Meaning, ...]]]) -> list[Span]:
    """Stretches of UTF-8 read two bytes a character: where from a matched beginning
    on the bytes are several ideographs in use, though not all that stands there is."""
    spans: list[Span] = []
    for pair in _REREAD:
        at = 0
        for a, _, ms in matches:
            if a < at or all(m[0] != pair for m in ms) or any(x[0] <= a < x[1] for x in spans):
                continue
            b, restored = _reread(text, a, pair[6:])
            whole = [c for c in restored if c != "\ufffd" and not c.isascii()]
            if len(whole) >= _RUN_WEAK and all(c in _usual() for c in whole) and not all(c in _usual() for c in text[a:b]):
                spans.append((a, b, pair, restored))
                at = b
    return sorted(spans)


def _automaton_spans(text: str, double: bool, model: Likelihood) -> list[Span]:
    chains: list[list[tuple[int, int, tuple[Meaning, ...]]]] = []
    matches = [(end + 1 - n, end + 1, ms) for end, (n, ms) in automaton(double).iter_long(text)]
    spans = _reread_spans(text, matches) if double else []
    at = 0
    for start, end, ms in matches:
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        ms = tuple(m for m in ms if m[0] not in _REREAD)
        if not ms or at < len(spans) and end > spans[at][0]:
            continue
        if chains and chains[-1][-1][1] >= start and {m[0] for m in ms} & {m[0] for m in chains[-1][-1][2]}:
            chains[-1].append((start, end, ms))
        else:
            chains.append([(start, end, ms)])
    total: dict[str, int] = {}
    for chain in chains:
        for _, _, ms in chain:
            for m in ms:
                total[m[0]] = total.get(m[0], 0) + 1

    def likely(pair: str, chain: list) -> float:
        return model.score_between(text, chain[0][0], chain[-1][1], "".join(c for _, _, ms in chain for p, c, _, _ in ms if p == pair))

    doubtful: list[tuple[int, int, tuple[Meaning, ...]]] = []
    for chain in chains:
        count: dict[str, int] = {}
        proof: set[str] = set()
        for _, _, ms in chain:
            for pair, _, proves, _ in ms:
                count[pair] = count.get(pair, 0) + 1
                if proves:
                    proof.add(pair)
        need: dict[str, int] = {}
        for _, _, ms in chain:
            for m in ms:
                need[m[0]] = min(m[3], need.get(m[0], m[3]))
        good = [p for p in count if p in proof or count[p] >= need[p]]
        good = [p for p in good if need[p] != _RUN_AS_DOUBLE or _odd_han(text[chain[0][0] : chain[-1][1]])]
        if not good:
            doubtful += chain
            continue
        best = max(good, key=lambda p: (count[p], p in proof, total[p], likely(p, chain)))  # the first listed at a tie
        for a, b, ms in chain:
            for pair, c, _, _ in ms:
                if pair == best:
                    spans.append((a, b, best, c))
    # what proves nothing alone is garbled where its line is proven to be, by the same pair
    lines = {(s[2], text.count("\n", 0, s[0])) for s in spans}
    for a, b, ms in doubtful if lines else ():
        line = text.count("\n", 0, a)
        for pair, c, _, need in ms:
            if need in (_RUN_WEAK, _RUN_WORD) and (pair, line) in lines:
                spans.append((a, b, pair, c))
                break
    return spans


@cache
def usual() -> Likelihood:
    """The model without a corpus."""
    return Likelihood()


def spans(text: str, model: Likelihood | None = None) -> list[Span]:
    """All garbled stretches of a text, in order, without overlap."""
    if text.isascii():
        return []
    model = model or usual()
    chars = set(text)
    taken = [False] * len(text)

    def take(more: list[Span]) -> list[Span]:
        for a, b, _, _ in more:
            taken[a:b] = [True] * (b - a)
        return more

    # long stretches of Cyrillic first: their bytes can also be read as ideographs
    runs = _runs_of(text)
    found = take(model.stretches(runs, taken, 4 * GAIN, CYRILLIC)) if sum([r[1] - r[0] for r in runs]) >= 12 else []
    if not chars.isdisjoint(_firsts(False)):
        found += take([x for x in _automaton_spans(text, False, model) if not any(taken[x[0] : x[1]])])
    if not chars <= _usual() and not chars.isdisjoint(_firsts(True)):
        found += take([x for x in _automaton_spans(text, True, model) if not any(taken[x[0] : x[1]])])
    found += take(model.stretches(runs, taken, GAIN))
    for m in _NEVER.finditer(text):
        if not taken[m.start()]:
            found.append((m.start(), m.end(), "lost", m.group()))
    return sorted(found)


def restore(text: str, model: Likelihood | None = None, first: list[Span] | None = None) -> tuple[str, int, list[str], int]:
    """(restored text, number of replaced spans, pairs, characters not restorable).

    A stretch is restored as a whole: what looks correct alone goes with the rest of
    its stretch. Restoring goes on until nothing changes, so text garbled several
    times comes back; a text seen before ends it. first: the text's spans, if known."""
    n, pairs, seen = 0, set(), {text}
    while True:
        here, first = first if first is not None else spans(text, model), None
        here = [s for s in here if s[2] != "lost" and s[3] != text[s[0] : s[1]]]
        out, at = [], 0
        for a, b, pair, orig in here:
            if a < at:
                continue
            out += [text[at:a], orig]
            at = b
            n += 1
            pairs.add(pair)
        text = "".join([*out, text[at:]])
        if text in seen:
            break
        seen.add(text)
    return text, n, sorted(pairs), len(_NEVER.findall(text))


def corpus_counts(documents: DataFrame, text: str) -> dict[str, int]:
    """pairs_in of all texts, added up per task and then over the tasks. The result
    is bounded by the square of the repertoire, not by the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            pairs_in([s for s in b.column(0).to_pylist() if s and not s.isascii()], seen)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["k", "n"])

    t = documents.select(text).mapInArrow(run, "k string, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(t["k"].to_pylist(), t["n"].to_pylist(), strict=True))


def garbled(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Documents with at least one garbled stretch: key, restored (the text as far
    as it can be restored), n_spans, pairs (written>read), n_lost (characters that
    stand for lost bytes). Null and empty texts and correct ones have no row; two
    passes over the table, of which the first counts sequences of two characters for
    the likelihood; copies stay as many as they are."""
    ship(documents.sparkSession)
    d = documents.select(key, text)
    kind = d.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("restored", T.StringType()), T.StructField("n_spans", T.IntegerType()), T.StructField("pairs", T.ArrayType(T.StringType())), T.StructField("n_lost", T.IntegerType())])
    counts = documents.sparkSession.sparkContext.broadcast(corpus_counts(documents, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Likelihood(counts.value)
        for b in batches:
            keep, rows = [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                if s and (first := spans(s, model)):
                    keep.append(i)
                    rows.append(restore(s, model, first))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.int32())], [key, "restored", "n_spans", "pairs", "n_lost"])

    return d.mapInArrow(run, schema)


def garbled_keys(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Only the keys of what garbled() gives, without the work of restoring."""
    ship(documents.sparkSession)
    d = documents.select(key, text)
    counts = documents.sparkSession.sparkContext.broadcast(corpus_counts(documents, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Likelihood(counts.value)
        for b in batches:
            keep = [i for i, s in enumerate(b.column(1).to_pylist()) if s and spans(s, model)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64()))], [key])

    return d.mapInArrow(run, T.StructType([d.schema[key]]))
