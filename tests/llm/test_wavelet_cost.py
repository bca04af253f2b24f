"""What building and reading token files costs beside plain array operations, and that their bytes are those of plain ones."""

import resource
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest

from tessella.functions import workers
from tessella.llm import wavelet


def by_masks(ids, bits):
    """The planes by the plainest stable sorts."""
    planes, values = [], ids
    for level in range(bits - 1, -1, -1):
        one = (values >> level) & 1 == 1
        planes.append(np.packbits(one, bitorder="little"))
        values = np.concatenate([values[~one], values[one]])
    return planes


def fastest(run):
    took = []
    for _ in range(4):
        begin = time.process_time()
        run()
        took.append(time.process_time() - begin)
    return min(took)


def test_a_file_costs_less_than_masks():
    ids = np.minimum(np.random.default_rng(2).zipf(1.1, 1 << 20), 49_000).astype(np.uint16)
    plain = fastest(lambda: by_masks(ids, 16))
    matrix = wavelet.WaveletMatrix.build(ids, 16)
    assert fastest(lambda: wavelet.WaveletMatrix.build(ids, 16)) < 0.7 * plain
    assert fastest(matrix.decode) < 0.6 * plain


@pytest.mark.parametrize("n", [0, 1, 511, 512, wavelet.BLOCK * 32 - 1, wavelet.BLOCK * 32, wavelet.BLOCK * 32 + 1, 100_000])
@pytest.mark.parametrize("bits, kind", [(16, np.uint16), (1, np.uint8), (18, np.uint32), (20, np.uint16), (17, np.int64)])
def test_planes_and_ids_at_the_ends_of_spans(n, bits, kind):
    ids = np.random.default_rng(n).integers(0, 1 << min(bits, 8 * np.dtype(kind).itemsize), n).astype(kind)
    given = ids.copy()
    matrix = wavelet.WaveletMatrix.build(ids, bits)
    for plane, want in zip(matrix.planes, by_masks(ids, bits), strict=True):
        assert plane[: len(want)].tobytes() == want.tobytes()
    assert (ids == given).all()
    assert zlib.crc32(matrix.decode().astype("<u4")) == zlib.crc32(ids.astype("<u4"))


FAULTS = """
import resource, sys
import numpy as np
from tessella.functions import workers
from tessella.llm import wavelet
ids = np.random.default_rng(2).integers(0, 49_000, 1 << 20).astype(np.uint16)
def run(batches):
    for _ in range(2):
        begin = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        wavelet.WaveletMatrix.build(ids, 16).decode()
        yield resource.getrusage(resource.RUSAGE_SELF).ru_minflt - begin
print(list(workers.tidy(run, *map(int, sys.argv[1:]))(iter([])))[-1])
"""


def test_a_workers_planes_are_not_mapped_anew():
    if workers._libc() is None or not resource.getrusage(resource.RUSAGE_SELF).ru_minflt:
        pytest.skip("another C library")
    faults = [int(subprocess.run([sys.executable, "-c", FAULTS, *a], capture_output=True, check=True, text=True).stdout) for a in ([], [str(wavelet.MAPPED)])]
    assert 3 * faults[1] < faults[0], faults
