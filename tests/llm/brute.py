"""Plain single-machine versions that the operators must agree with."""

import hashlib
import re
from collections import defaultdict


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def shingles(text, width=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1)))


def near_duplicates(rows, percent=85):
    """{doc_id: (n_shingles, component_id, kept)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1:]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    found = components(sets, links)
    return {i: (len(s), found[i], found[i] == i) for i, s in sets.items()}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def personal_data(text):
    """(counts by kind, digest of the spans) by the plain patterns."""
    spans = []
    for place, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((m.start(), place, m.end(), kind))
    spans.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return tuple(sum(s[3] == k for s in spans) for k in PII), hashlib.sha256(joined.encode()).hexdigest()


ASSIGN = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def secrets(text):
    """((n_assign, n_access, n_hex), digest of the spans) by the plain patterns."""
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, text or "") if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    spans.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return tuple(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()


def credential_parts(text, patterns):
    """Spans of weak parts that are completed, by comparing all pairs: {(kind, start, end)}."""
    parts = []
    for place, (kind, pattern, group) in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            value, scope = m[group], len(re.findall(r"\n[ \t\r]*\n", text[:m.start()]))
            mixed = bool(re.search("[A-Za-z]", value) and re.search("[0-9]", value))
            weak = place >= 3 or place == 0 and len(value) < 12
            kind = "secret" if weak and place == 0 else patterns[place][0]
            if kind == "secret" and not (mixed and len(value) >= 6):
                continue
            role = {0: "secret", 1: "identifier", 2: "secret" if mixed else None}.get(place, kind)
            parts.append((kind, m.start(), m.end(), scope, role, weak))
    strong = [p for p in parts if not p[5]]
    parts = [p for p in parts if not p[5] or not any(s[1] < p[2] and p[1] < s[2] for s in strong)]
    fits = {("identifier", "secret"), ("secret", "identifier"), ("secret", "endpoint"), ("endpoint", "secret")}
    return {p[:3] for p in parts if p[5] for o in parts if (p[4], o[4]) in fits and p[3] == o[3]
            and min(abs(a - b) for a in (p[1], p[2] - 1) for b in (o[1], o[2] - 1)) <= 400}


def periodic_runs(words):
    """Sorted (start, length, period) of maximal runs, trying every period."""
    found, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(24, 3 * q) and not any(
                    all(words[j] == words[j + p] for j in range(start, start + length - p)) for p in range(1, q)):
                found.append((start, length, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))
