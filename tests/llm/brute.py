"""Plain versions of what the operators compute, for small inputs."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, full=True):
    return WORD.findall(text.lower() if full else re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles(text, n=5):
    own = words(text)
    return {tuple(own[k: k + n]) for k in range(max(len(own) - n + 1, 1))} if own else set()


def classes(texts, least=(4, 5)):
    """(class, links) of each key, by comparing all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root, links = {k: k for k in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and (x == y or least[1] * len(x & y) >= least[0] * len(x | y)):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (find(k), links[k]) for k in sets}
