"""Scan-order samplers on small densities worked out by hand."""

import numpy as np

from tessella.operators import sampling as S


def test_far_diffusion_gathers_aligned_runs():
    d = np.zeros((1, 16))
    d[0, 0], d[0, 1], d[0, 8] = 0.005, 0.6, 0.3
    # 0.5 % makes a run of 8 that skips the 0.6; half of its 0.605 (7/16 + 1/16, in the same row) reaches x = 8: 0.6025
    assert S.error_diffusion_far(d).tolist() == [[8.5, 0.5]]


def test_layers_share_the_rest_with_neighbours():
    d = np.kron(np.array([[0.6, 0.2], [0.0, 0.8]]), np.full((2, 2), 0.25))
    # 1.6 at the top goes down; (0, 0) emits and leaves -0.4: 7, 5, 1 thirteenths; (1, 1) gets -0.031, -0.154 and -0.010: 0.606
    got = S.error_diffusion_layers(d)
    assert np.floor(got / 2).tolist() == [[0, 0], [1, 1]]
    assert len(S.error_diffusion_layers(d * 0.9)) == 1  # 1.44 is one point of the top
