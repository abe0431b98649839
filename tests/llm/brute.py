"""Plain definitions that the operators are held against."""


def reach(nodes, linked):
    """The smallest node that each node reaches; ``linked`` tells of a pair."""
    nodes = list(nodes)
    least = {n: n for n in nodes}

    def root(n):
        while least[n] != n:
            n = least[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                low, high = sorted((root(a), root(b)))
                least[high] = low
    return {n: root(n) for n in nodes}
