import numpy as np

from weftline.functions import subjects as S


def picture(h=240, w=320, box=(100, 60, 80, 90), colour=(180, 40, 40)):
    yy, xx = np.mgrid[0:h, 0:w]
    a = np.stack([200 + 40 * xx / w, 200 + 30 * yy / h, np.full((h, w), 215.0)], axis=2)
    x, y, bw, bh = box
    a[y : y + bh, x : x + bw] = colour
    return a.astype(np.uint8)


def near(got, want, by=8):
    return all(abs(g - w) <= by for g, w in zip(got, want, strict=True))


def test_subject_on_a_sloping_background():
    found = S.detect(picture())
    assert near(found["box"], (100, 60, 80, 90)) and found["confidence"] > 0.8
    assert near(S.salient_box(picture()), (100, 60, 80, 90), 24)


def test_nothing_there():
    flat = np.full((50, 60, 3), 230, np.uint8)
    assert S.detect(flat) == {"box": (0, 0, 60, 50), "confidence": 0.0} and S.salient_box(flat) == (0, 0, 60, 50) and S.interior(flat) is None
    assert S.promoted((1, 2, 3, 4), S.detect(flat), (50, 60)) == (1, 2, 3, 4)


def test_promotion_and_hint():
    a = picture(colour=(215, 208, 214))
    hinted = S.detect(a, colour=(215, 208, 214), background="SOLIDCOLOR")
    assert hinted["confidence"] >= S.detect(a)["confidence"]
    assert near(S.promoted((0, 0, 320, 240), S.detect(picture()), (240, 320)), (100, 60, 80, 90))


def test_interior_finds_the_varied_patch():
    r = np.random.default_rng(1)
    a = np.full((120, 120), 128, np.uint8)
    a[40:88, 40:88] = r.integers(0, 255, (48, 48))
    x, y, w, h = S.interior(a)
    shared = max(0, min(x + w, 88) - max(x, 40)) * max(0, min(y + h, 88) - max(y, 40))
    assert shared >= 0.6 * 48 * 48 and w * h <= 3 * 48 * 48


def test_parts():
    m = np.zeros((10, 10), bool)
    m[1:3, 1:3] = m[5:9, 5:9] = True
    assert [len(c) for c in S.components(m)] == [16, 4] and S.components(np.zeros((3, 3), bool)) == []
    assert np.allclose(S.box_mean(np.ones((5, 7)), 2), 1) and S.closed(np.ones((9, 9), bool)).all()
    assert abs(S.opponent(np.full((1, 1, 3), 255, np.uint8))[0, 0, 0] - 100) < 0.1
