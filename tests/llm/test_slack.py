"""What the estimate of a pair may lose."""

from math import comb

from alertloom.llm import neardup


def test_the_estimate_loses_no_more_than_the_bands():
    m, q = neardup.BANDS * neardup.ROWS, neardup.THRESHOLD
    lost = sum(comb(m, k) * q**k * (1 - q) ** (m - k) for k in range(m + 1) if k / m < q - neardup.SLACK)
    bands = (1 - q**neardup.ROWS) ** neardup.BANDS
    assert lost <= max(bands, 5e-6)
