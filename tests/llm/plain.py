"""Plain versions of the operators, to compare with: slow, direct, and on rows in memory."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def suffix_dedup(texts, width=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + width] for t in raw for i in range(len(t) - width + 1))
    out = []
    for t in raw:
        cut = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                cut[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(t)) if cut[i] and not (i and cut[i - 1]))
        out.append((len(t), sum(cut), spans, sha(bytes(x for x, c in zip(t, cut) if not c))))
    return out


def decontaminate(texts, items, width=10):
    """(n_words, n_hit, n_items, items_sha256, contaminated) of each text."""
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM_WORD.findall(lower(text))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w = ALNUM_WORD.findall(lower(t))
        hit, found = [0] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    found |= windows[tuple(w[i : i + n])]
                    hit[i : i + n] = [1] * n
        out.append((len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0))
    return out


def shingles(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(docs):
    """doc_id -> (n_shingles, component_id, kept), for rows of different ids."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def substring_dedup(docs, width=13):
    """(n_words, n_removed, kept_sha256) of each row (doc_id, text)."""
    rows = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in rows:
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in rows:
        cut = [0] * len(w)
        if i is not None:
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < i:
                    cut[k : k + width] = [1] * width
        out.append((len(w), sum(cut), sha(" ".join(x for x, c in zip(w, cut) if not c))))
    return out


def base_rules(t):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    mark = [0] * len(w)
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            mark[i : i + 3] = [1, 1, 1]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(mark), len(w) < 50 or 100 * sum(mark) > 50 * len(w)


def rule_verdicts(rows, common, min_chars, min_words, language_words, char_limit, word_limit):
    """(base_failed, character distance, word distance, kept) of rows (doc_id, text, language)."""

    def kind(c):
        if "a" <= c <= "z" or "A" <= c <= "Z":
            return "lower" if c >= "a" else "upper"
        if "0" <= c <= "9":
            return "digit"
        if c in " \n":
            return c
        if c in "#*$%&|<>":
            return "symbol"
        return "punctuation" if "!" <= c <= "~" else "control" if c < "\x80" else "other"

    def histograms(t):
        words = [w if w in common else "" for w in WORD.findall(lower(t))]
        return Counter(map(kind, t)), Counter(words)

    def distance(p, q):
        n, m = sum(p.values()), sum(q.values())
        if not n or not m:
            return 0.0
        both = [(p[k] / n, q[k] / m) for k in {*p, *q}]
        bits = sum(a * math.log2(2 * a / (a + b)) for a, b in both if a) + sum(b * math.log2(2 * b / (a + b)) for a, b in both if b)
        return math.sqrt(max(bits, 0) / 2)

    found = [(base_rules(t)[-1], *histograms(t or "")) for _, t, _ in rows]
    by = defaultdict(lambda: (Counter(), Counter()))
    for (_, _, lang), (failed, chars, words) in zip(rows, found):
        if not failed:
            for key in {lang or "", None}:  # None: all languages
                by[key][0].update(chars)
                by[key][1].update(words)
    out = []
    for (_, _, lang), (failed, chars, words) in zip(rows, found):
        chosen = by[lang] if lang and sum(by[lang][1].values()) >= language_words else by[None]
        a = distance(chars, chosen[0]) if sum(chars.values()) >= min_chars else 0.0
        b = distance(words, chosen[1]) if sum(words.values()) >= min_words else 0.0
        out.append((failed, round(a, 5), round(b, 5), not failed and a <= char_limit and b <= word_limit))
    return out


def recurring_lines(docs, least=3):
    """Kept text of each row (doc_id, text), None for a null text."""

    def tokens(line):
        return tuple(x for x in re.split(r"[ \t\x0B\f\r]+", re.sub(r"[^ \t\x0B\f\r]*[0-9@/][^ \t\x0B\f\r]*", "<*>", line)) if x)

    texts = {t: [tokens(x) for x in t.split("\n")] for t in {t for _, t in docs if t is not None}}
    depth = lambda line: min(len(line), 2) if len(line) < 12 else 4
    leaf_of = lambda line: (len(line), line[: depth(line)])
    holders = defaultdict(set)
    for t, lines in texts.items():
        for line in lines:
            holders[line].add(t)
    in_leaf, held = Counter(), Counter()
    for line, by in holders.items():
        in_leaf[leaf_of(line)] += len(by)
        for i, x in enumerate(line):
            held[leaf_of(line), i, x] += len(by)

    def known(line, n):  # which tokens are known at their places in n texts
        return [in_leaf[leaf_of(line)] >= n and (i < depth(line) or held[leaf_of(line), i, x] >= n) for i, x in enumerate(line)]

    def template(line):
        at = known(line, least)
        return (leaf_of(line), tuple(x if k else None for x, k in zip(line, at))) if line and 2 * sum(at) >= len(line) else None

    in_texts, copies = defaultdict(set), set()
    for t, lines in texts.items():
        same = [sum(known(line, 2)) for line in lines]
        size = sum(map(len, lines))
        if size >= 20 and 100 * sum(k for k, line in zip(same, lines) if 2 * k >= len(line)) >= 85 * size:
            copies.add(t)
        for line in lines:
            in_texts[template(line)].add(t)
    recur = {k for k, v in in_texts.items() if k and len(v) >= max(least, 2 * len(v & copies))}
    return [None if t is None else "\n".join(x for x in t.split("\n") if template(tokens(x)) not in recur) for _, t in docs]
