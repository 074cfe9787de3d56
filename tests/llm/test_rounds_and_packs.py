"""F1, F2 and F3 of round 3: what a round of links carries, and how often a pre-token is looked up."""

from collections import Counter

from riskloom.llm.ngramjoin import class_of_documents, ngram_join
from riskloom.llm.tokencount import _Pack, pre_tokens


def group(members, length, own):
    """Texts that share all words but ``own`` of them, too far apart to link."""
    base = [f"w{i}" for i in range(length)]
    step = length // own
    return [(m, " ".join(f"m{m}x{i}" if i % step == m % step else w for i, w in enumerate(base))) for m in range(members)]


def test_a_group_of_two_hundred_takes_two_rounds_of_narrow_rows(spark, monkeypatch):
    from riskloom.llm import linking

    meet, rounds, columns = linking.met, [], []

    def noted(rows, percent, hubs, turn):
        rounds.append(hubs)
        columns.append(set(rows.columns))
        return meet(rows, percent, hubs, turn)

    monkeypatch.setattr(linking, "met", noted)
    rows = [*group(200, 60, 2), (200, "some words that are twice here"), (201, "Some  words that are twice here")]
    members, classes, _ = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in class_of_documents(members, classes).collect()}
    words = {i: t.lower().split() for i, t in rows}
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, w in words.items()}
    want = {i: i for i in sets}
    for i in sorted(sets):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert got == want
    assert rounds == [1, None]
    assert columns == [{"shingle", "key", "n", "at", "up", "root"}, {"shingle", "key", "n", "at", "up", "root", "sketch"}]


def test_each_pre_token_is_cut_once_a_pack():
    head = {"the": 1, ",": 2, " of": 3}
    cuts = []

    def cut(token):
        cuts.append(token)
        return [token[:-1], "▁,"] if token.endswith(",") else [token]

    texts = ["the the rare, the", "", "rare, other  of other", "the rare"]
    pack = _Pack(0)
    pack.add([1, 2, 3], [True, True, False], texts[:3], {**head, "▁,": 2}, cut)
    pack.add([4], [True], texts[3:], {**head, "▁,": 2}, cut)
    assert max(Counter(cuts).values()) == 1
    assert [k for x in pack.known for k in x.tolist()] == [5, 0, 5, 1]
    names = list(pack.names)
    found = Counter()
    for name, at, freq in zip(pack.name, pack.at, pack.freq, strict=True):
        for x, y, z in zip(name.tolist(), at.tolist(), freq.tolist(), strict=True):
            found[names[x], y] += z
    assert found == {("rare", 0): 1, ("rare", 2): 1, ("other", 2): 2, ("rare", 3): 1}
    assert set(pre_tokens(texts[2])) == {"rare,", "other", " of"}
