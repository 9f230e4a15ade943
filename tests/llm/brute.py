"""Plain versions of the operators, over Python lists, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


SECRETS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def secrets(text: str | None) -> tuple[dict[str, int], str]:
    spans, counts = [], {}
    for rank, (kind, pattern, group, least) in enumerate(SECRETS):
        found = [m for m in pattern.finditer(text or "") if len(m[group]) >= least]
        counts[kind] = len(found)
        spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in found]
    return counts, ",".join(s for *_, s in sorted(spans))


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n, repeat = len(words), len(covered)
    failed = n < 20 or 100 * repeat > 30 * n
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeat, failed


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_duplicates(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> set size, component id; pairs that share no shingle are not compared."""
    sets = {i: shingles(text) for i, text in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, done = defaultdict(list), set()
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    for group in holders.values():
        for j in range(len(group)):
            for k in range(j):
                pair = (group[k], group[j])
                if pair in done:
                    continue
                done.add(pair)
                a, b = sets[pair[0]], sets[pair[1]]
                if 100 * len(a & b) >= 75 * len(a | b):
                    x, y = find(pair[0]), find(pair[1])
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contamination(docs, items) -> dict[int, tuple[int, int, int, str, bool]]:
    words_of = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item_id, text in items:
        words = words_of(text)
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(str(item_id))
    lengths, out = {len(w) for w in windows}, {}
    for doc_id, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                found = windows.get(tuple(words[i : i + n]))
                if found:
                    ids |= found
                    hit.update(range(i, i + n))
        bad = bool(hit) and 20 * len(hit) >= len(words)
        out[doc_id] = (len(words), len(hit), len(ids), sha(",".join(sorted(ids))), bad)
    return out


def token_rows(docs, tokenizer) -> dict[int, tuple[int, int, int]]:
    start, out = 0, {}
    for doc_id, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc_id] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def keeps(text: str | None, stop_words) -> bool:
    """The quality verdict with the production bounds."""
    n, chars, symbols, dup, repeat, failed = quality(text)
    if failed:
        return False
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    stop = sum(w.lower() in stop_words for w in words)
    bad_length = chars / n < 2.5 or chars / n > 12.0
    few_stop = n >= 50 and stop / n < 0.01
    many_lines = len(lines) >= 3 and dup / len(lines) > 0.6
    return not (bad_length or symbols / n > 0.2 or few_stop or many_lines or repeat / n > 0.3)


def mix(rows, seed="mix-1", weights=(1, 2, 3), cap=3):
    """(doc_id, text, source) -> the texts of the mix as (doc_id, text), whole ones first."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, still, target = sum(sizes.values()), set(order), {}
    while still:
        share = sum(weight[s] for s in still)
        over = [s for s in still if left * weight[s] >= share * cap * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / share for s in still}
            break
        target |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        still -= set(over)
    out = []
    for source in order:
        place = lambda r: hashlib.md5(f"{seed}:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
        own = sorted((r for r in rows if r[2] == source), key=place)
        epochs, rest = divmod(int(target[source] + 0.5), max(1, sizes[source]))
        for doc_id, text, _ in own:
            n = len(WORD.findall(text or ""))
            out += [(doc_id, text)] * (epochs if n else 0)
            if 0 < rest and n:
                ends = [m.end() for m in WORD.finditer(text)]
                out.append((doc_id, text if n <= rest else text[: ends[rest - 1]]))
                rest -= min(n, rest)
    return out
