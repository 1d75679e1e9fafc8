"""Plain single-process forms of the tree learners, to compare with."""

from math import exp, log


class Plain:
    """rows: lists of bins (0: missing number) or categories; y: labels. Follows the definitions split by split."""

    def __init__(self, rows, y, categorical, growth):
        self.rows, self.y, self.cats, self.g = rows, y, categorical, growth

    def score(self, g, h, l2):
        g = max(abs(g) - self.g.l1, 0.0) * (1 if g > 0 else -1)
        return g * g / (h + l2)

    def sums(self, at):
        return sum(self.grad[i] for i in at), sum(self.hess[i] for i in at), len(at)

    def splits(self, at):
        """(gain, rank, goes_left) of every allowed split of a node's rows."""
        all_g, all_h, _ = self.sums(at)
        for f in range(len(self.rows[0])):
            if f in self.cats:
                groups = {}
                for i in at:
                    groups.setdefault(self.rows[i][f], []).append(i)
                ratio = {c: self.sums(x)[0] / (self.sums(x)[1] + self.g.smooth) for c, x in groups.items()}
                order = sorted(groups, key=lambda c: ratio[c])
                for k in range(1, len(order)):
                    if k <= self.g.most_categories or len(order) - k <= self.g.most_categories:
                        low, high, few = frozenset(order[:k]), frozenset(order[k:]), k <= self.g.most_categories
                        yield f, k, False, (lambda v, low=low, high=high, few=few: v in low if few else v not in high), self.g.l2 + self.g.category_l2
            else:
                here = sorted({self.rows[i][f] for i in at} - {0})
                for place, t in enumerate(here, 1):
                    for side in (False, True) if any(self.rows[i][f] == 0 for i in at) else (False,):
                        yield f, place, side, (lambda v, t=t, side=side: side if v == 0 else v <= t), self.g.l2
        return all_g, all_h

    def best(self, at):
        found = None
        all_g, all_h, _ = self.sums(at)
        for f, place, side, left, l2 in self.splits(at):
            a, b = [i for i in at if left(self.rows[i][f])], [i for i in at if not left(self.rows[i][f])]
            (ga, ha, na), (gb, hb, nb) = self.sums(a), self.sums(b)
            if min(na, nb) < max(self.g.least_rows, 1) or min(ha, hb) < self.g.least_weight:
                continue
            gain = round(self.score(ga, ha, l2) + self.score(gb, hb, l2) - self.score(all_g, all_h, self.g.l2), 9)
            if gain > self.g.gamma and (found is None or (gain, -f, -place, not side) > found[0]):
                found = ((gain, -f, -place, not side), f, left, a, b, l2)
        return found

    def value(self, at, l2):
        g, h, _ = self.sums(at)
        g = max(abs(g) - self.g.l1, 0.0) * (1 if g > 0 else -1)
        return -self.g.rate * g / (h + l2)

    def by_level(self, at, depth, l2=None):
        found = self.best(at) if depth < self.g.depth else None
        if found is None:
            return [(at, l2)]
        _, _, _, a, b, l2 = found
        return self.by_level(a, depth + 1, l2) + self.by_level(b, depth + 1, l2)

    def by_leaf(self, at):
        leaves = [(at, None, 0, self.best(at))]
        while len(leaves) < self.g.leaves:
            open_ = [x for x in leaves if x[3] is not None]
            if not open_:
                break
            x = max(open_, key=lambda x: x[3][0][0])
            leaves.remove(x)
            _, _, _, a, b, l2 = x[3]
            leaves += [(side, l2, x[2] + 1, self.best(side) if x[2] + 1 < self.g.depth else None) for side in (a, b)]
        return [(at, l2) for at, l2, _, _ in leaves]

    def symmetric(self, at):
        nodes = [at]
        for _ in range(self.g.depth):
            found = None
            for f in range(len(self.rows[0])):
                for t in range(1, self.g.bins + 1):
                    for side in (False, True):
                        left = lambda v, t=t, side=side: side if v == 0 else v <= t
                        parts = [([i for i in n if left(self.rows[i][f])], [i for i in n if not left(self.rows[i][f])]) for n in nodes]
                        if min(sum(len(p[k]) for p in parts) for k in (0, 1)) < max(self.g.least_rows, 1):
                            continue
                        gain = round(sum(sum(self.score(*self.sums(x)[:2], self.g.l2) for x in p) - self.score(*self.sums(n)[:2], self.g.l2) for n, p in zip(nodes, parts)), 9)
                        if gain > self.g.gamma and (found is None or (gain, -f, -t, not side) > found[0]):
                            found = ((gain, -f, -t, not side), parts)
            if found is None:
                break
            nodes = [x for p in found[1] for x in p if x]
        return [(n, self.g.l2) for n in nodes]

    def boost(self):
        rate = sum(self.y) / len(self.y)
        margin = [log(rate / (1 - rate))] * len(self.y)
        for _ in range(self.g.rounds):
            p = [1 / (1 + exp(-m)) for m in margin]
            self.grad, self.hess = [a - b for a, b in zip(p, self.y)], [a * (1 - a) for a in p]
            at = list(range(len(self.y)))
            leaves = self.symmetric(at) if self.g.symmetric else self.by_leaf(at) if self.g.leaves else self.by_level(at, 0)
            if len(leaves) == 1:
                break
            for rows, l2 in leaves:
                v = self.value(rows, l2)
                for i in rows:
                    margin[i] += v
        return [1 / (1 + exp(-m)) for m in margin]
