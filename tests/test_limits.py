import pytest

from tarnhold import errors as E
from tarnhold.functions.limits import Limits, check_compression_ratio, check_file_count, parse_size, resolve_limits


@pytest.mark.parametrize("given,size", [(5, 5), (5.9, 5), ("10", 10), ("1.5 kib", 1536), (" 2KB ", 2000), ("1tib", 2**40), ("3 gb", 3 * 10**9), ("0b", 0)])
def test_sizes(given, size):
    assert parse_size(given) == size


@pytest.mark.parametrize("given", ["", "x", "1 zb", "-1", -1, float("nan"), float("inf"), True, "1" * 65, None, "9007199254740992", "1e3"])
def test_bad_sizes(given):
    with pytest.raises(E.InvalidInputError):
        parse_size(given)


def test_limits():
    assert resolve_limits(max_total_size="1kib", max_files=None) == Limits(max_total_size=1024)
    for bad in ({"max_files": -1}, {"max_depth": 1.5}, {"max_compression_ratio": 0}, {"nothing": 1}):
        with pytest.raises(E.InvalidInputError):
            resolve_limits(**bad)
    check_file_count(3, Limits(max_files=3))
    with pytest.raises(E.FileCountExceededError):
        check_file_count(4, Limits(max_files=3))
    check_compression_ratio(1000, 0, Limits())
    with pytest.raises(E.CompressionRatioExceededError):
        check_compression_ratio(1010, 10, Limits())


def test_error_tree():
    assert len(E.CODES) == len(set(E.CODES.values())) == 42
    assert issubclass(E.WindowsDeviceError, E.PathPolicyError) and issubclass(E.LinkEscapeError, E.LinkPolicyError)
    assert isinstance(E.from_code("LIMIT_DEPTH", "x"), E.DepthExceededError)
