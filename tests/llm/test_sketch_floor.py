"""The sketch loses fewer links than the bands do."""

import pytest

from halocline.llm import minhash


@pytest.mark.parametrize("percent", [80, 85])
def test_sketch_loses_less_than_bands(percent):
    places = round(minhash.floor_of(percent) * minhash.SKETCH)
    assert places < (percent / 100 - 0.17) * minhash.SKETCH
    assert minhash.below(places, percent) <= minhash.unbanded(percent) / 10
    assert minhash.missed(percent) <= 1.1 * minhash.unbanded(percent)
