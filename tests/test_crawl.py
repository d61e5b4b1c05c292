"""Crawls with redirects and limits against a queue that visits page by page."""

import random
from collections import deque

import pytest

from offerloom.operators import crawl as cr


def ends(redirects):
    out = {}
    for u in redirects:
        seen, at = set(), u
        while at in redirects and at not in seen:
            seen.add(at)
            at = redirects[at]
        out[u] = None if at in redirects else at
    return out


def plain(seeds, links, redirects, depth, pages, urls):
    final = ends(redirects)
    queue, known, ended, visited, found = deque((u, 0) for u in seeds), set(seeds), set(), [], []
    while queue and len(visited) < pages:
        url, d = queue.popleft()
        if url in ended or url in [v[0] for v in visited]:
            continue
        end = final.get(url, url)
        visited.append((url, end, d))
        if end is None:
            continue
        ended.add(end)
        known.add(end)
        if d < depth:
            for target, nofollow in links.get(end, []):
                if nofollow or target in known:
                    continue
                if len(found) >= urls:
                    return found, visited
                found.append((target, end, d + 1))
                known.add(target)
                queue.append((target, d + 1))
    return found, visited


@pytest.mark.parametrize("seed, pages, urls", [(1, 1000, 1000), (2, 9, 1000), (3, 1000, 7), (4, 1000, 1000), (5, 14, 20)])
def test_crawl_equals_a_queue(spark, seed, pages, urls):
    rng = random.Random(seed)
    names = [f"u{k}" for k in range(40)]
    links = {u: [(rng.choice(names), rng.random() < 0.15) for _ in range(rng.randint(0, 4))] for u in names}
    redirects = {u: rng.choice(names) for u in rng.sample(names, 12)}
    redirects = {u: t for u, t in redirects.items() if u != t}
    redirects |= {"u1": "u2", "u2": "u3", "u3": "u1"} if seed == 4 else {}
    seeds = rng.sample(names, 3)
    rows = [(u, t, k, n) for u, out in links.items() for k, (t, n) in enumerate(out)]
    found, visited = cr.crawl(
        spark.createDataFrame([(u, k) for k, u in enumerate(seeds)], "url string, position int"), spark.createDataFrame(rows, "url string, target string, position int, nofollow boolean"),
        spark.createDataFrame(list(redirects.items()), "url string, target string"), 3, pages, urls,
    )
    want_found, want_visited = plain(seeds, links, redirects, 3, pages, urls)
    assert [(r.url, r.parent, r.depth) for r in found.orderBy("discovery_index").collect()] == want_found
    assert [(r.url, r.final_url, r.depth) for r in visited.orderBy("discovery_index").collect()] == want_visited


def test_redirect_chains_and_loops(spark):
    chain = [(f"c{k}", f"c{k + 1}") for k in range(37)] + [("l1", "l2"), ("l2", "l1"), ("h", "l1"), ("s", "s")]
    got = {r.url: r.final for r in cr.final_urls(spark.createDataFrame(chain, "url string, target string")).collect()}
    assert got == {f"c{k}": "c37" for k in range(37)} | dict.fromkeys(("l1", "l2", "h"))
    assert cr.final_urls(spark.createDataFrame([], "url string, target string")).count() == 0
