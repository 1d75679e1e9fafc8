"""Plain single-process forms of the operators, to compare with."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from math import log10

import numpy as np
import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def crc_ids(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def op1(docs, window=50):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in docs]
    key = lambda d: (d is None, d)
    for d, t in texts:
        for i in range(len(t) - window + 1):
            s = t[i : i + window]
            if s not in first or key(d) < key(first[s]):
                first[s] = d
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if key(first[t[i : i + window]]) < key(d):
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha256(kept).hexdigest()))
    return out


def op2(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[SPACE.sub(" ", t or "")].append(d)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(d, keep, len(ids), d == keep, sha256(t.encode()).hexdigest()) for d in ids]
    return out


def op3(docs, tokenizer, end=2):
    out, start = [], 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, start, len(ids), crc_ids(ids)))
        start += len(ids)
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def op4(docs):
    """(doc_id, counts of the four kinds, base_sha256, base spans)"""
    out = []
    for d, t in docs:
        found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, t or "") if ok(m[0])]
        text = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found))
        out.append((d, *(sum(k == i for _, k, _ in found) for i in range(4)), sha256(text.encode()).hexdigest(), text))
    return out


def op5(docs):
    """Without kept."""
    out = []
    for d, t in docs:
        t = t or ""
        words = WORD.findall(t)
        lines, dups = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dups += line in lines
                lines.add(line)
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {p for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for p in (i, i + 1, i + 2)}
        n, r = len(words), len(covered)
        out.append((d, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dups, r, n < 50 or 100 * r > 50 * n))
    return out


def fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op6(docs):
    prints = [(d, fingerprint(t or "")) for d, t in docs]
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    arr = np.array(distinct, np.uint64)
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2):
            a, b = find(f), find(distinct[j])
            parent[max(a, b)] = min(a, b)
    low = {}
    for d, f in prints:
        r = find(f)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [(d, f"{f:016x}", low.get(find(f))) for d, f in prints]


def op8(docs, held=2, folds=7):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)"""
    tokens = [(d, [*WORD.findall(lower(t or "")), None]) for d, t in docs]
    out_of = lambda d: d is not None and zlib.crc32(str(d).encode()) % folds == held
    c = Counter(x for d, ts in tokens if not out_of(d) for x in ts)
    n, v = sum(c.values()), len(c)
    return [(d, out_of(d), len(ts), sum(c[x] > 0 for x in ts), n, sum(log10((c[x] + 1) / (n + v + 1)) for x in ts)) for d, ts in tokens]


def op11(docs, byte_path, piece_path):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(byte_path), SentencePieceProcessor(model_file=piece_path)
    a_model.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    a_bytes = lambda i: bytes(alphabet[c] for c in a_model.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for d, t in docs:
        groups, a, b = [], [], []
        if t:
            a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
            if b"".join(map(a_bytes, a)) != (" " + t).encode() or b"".join(map(b_bytes, b)) != (" " + t).encode():
                a, b = [], []
        i = j = at_a = at_b = 0
        left, right = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                left, at_a, i = [*left, a[i]], at_a + len(a_bytes(a[i])), i + 1
            else:
                right, at_b, j = [*right, b[j]], at_b + len(b_bytes(b[j])), j + 1
            if at_a == at_b:
                groups.append((left, right))
                left, right = [], []
        found.append((d, len(a), len(b), groups, Counter((x, y) for xs, ys in groups for x in xs for y in ys)))
    count = Counter(p for *_, links in found for p in links)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for d, n_a, n_b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(m for p, m in links.items() if count[p] == best[p[0]])
        out.append((d, n_a, n_b, len(groups), sum(links.values()), n_best, sum(m * count[p] for p, m in links.items()), sha256(text.encode()).hexdigest() if groups else ""))
    return out


def op13(pages, rules, order, share):
    """(page_id, host, path, rule, verdict, difference, cut); rules are (verdict, host, path)."""
    from math import log

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        return lower(host), path

    rows = []
    for page, url in pages:
        host, path = parts(url)
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, _, rule, verdict = max(fit, default=(0, 0, None, None))
        rows.append((page, url or "", host, path, rule, verdict))
    symbols = lambda url: [0] * order + [ord(c) - 30 if 32 < ord(c) < 127 else 2 for c in url] + [1]
    held = lambda url: zlib.crc32(url.encode()) % 5 == 0
    n, total, kinds, size = Counter(), Counter(), defaultdict(set), Counter()
    for _, url, _, _, _, v in rows:
        if v and not held(url):
            s = symbols(url)
            for i in range(order, len(s)):
                size[v] += 1
                for k in range(order + 1):
                    context = (v, *s[i - k : i])
                    n[context, s[i]] += 1
                    total[context] += 1
                    kinds[context].add(s[i])

    def score(v, url):
        s, out = symbols(url), 0.0
        for i in range(order, len(s)):
            p = 1 / 96
            for k in range(order + 1):
                context = (v, *s[i - k : i])
                if total[context] and total[context] >= size[v] * share:
                    t = len(kinds[context])
                    p = (n[context, s[i]] + t * p) / (total[context] + t)
            out += log(p)
        return out / (len(s) - order)

    both = size["allow"] and size["block"]
    difference = lambda url: score("allow", url) - score("block", url)
    tried = [(difference(u), v) for _, u, _, _, _, v in rows if v and held(u)] if both else []
    counts = Counter(v for _, v in tried)
    limit = 0.0
    if counts["allow"] and counts["block"]:
        at = lambda d: min(int((min(max(d, -10), 10) + 10) * 200), 3999)
        bins = {v: np.bincount([at(d) for d, x in tried if x == v], minlength=4000) for v in counts}
        errors = [(round(bins["allow"][:e].sum() / counts["allow"] + bins["block"][e:].sum() / counts["block"], 12), abs(e - 2000), e) for e in range(4001)]
        limit = min(errors)[2] / 200 - 10
    out = []
    for page, url, host, path, rule, verdict in rows:
        d = None if verdict or not both else difference(url)
        out.append((page, host, path, rule, verdict or ("allow" if d is None or d >= limit else "block"), d, limit))
    return out


def op12(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, seq in sorted(rebuilt.items()):
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                children[seq[: d - 1]].add(seq[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = own_saved + sum(saved[x] for x in children[node])
    return [
        (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n in members
    ]
