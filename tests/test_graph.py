import random
import time

from skein.operators import graph


def plain(g, n):
    """Depth-first from n, each node walked once."""
    seen = {n}

    def walk(x):
        best = 0
        for d in g[x]:
            if d in seen:
                best = max(best, 1)
            else:
                seen.add(d)
                best = max(best, 1 + walk(d))
        return best

    return walk(n)


def test_layer_depths_equal_single_walks():
    rng = random.Random(3)
    for k in range(600):
        n = rng.randrange(1, 12)
        g = {i: [] for i in range(n)}
        for _ in range(rng.randrange(0, n + 1 + k % 8)):
            g[rng.randrange(n)].append(rng.randrange(n))
        g = {x: list(dict.fromkeys(ds)) for x, ds in g.items()}
        assert graph._depths(g) == {x: plain(g, x) for x in g}, g


def test_layers_of_a_long_chain_take_one_pass():
    n, t = 200_000, time.monotonic()
    got = graph._depths({i: [i + 1] if i < n else [] for i in range(n + 1)})
    assert got[0] == n and got[n] == 0 and time.monotonic() - t < 60  # walks of each node: 2 * 10^10 steps
