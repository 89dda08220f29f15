"""Best-fit packing against a plain model of its rule: one list of bins, one loop over them a piece."""

import random

import numpy as np

from logweft.llm import packing


def model(lengths, capacities):
    """Bins as (final size, contents in order)."""
    bins, moment = [], 0                                   # [opened size, contents, when it last changed]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for place, i in enumerate(order):
        length, moment = lengths[i], moment + 1
        fitting = [b for b in bins if b[0] - sum(lengths[k] for k in b[1]) >= length]
        if fitting:
            # the fullest; of equally full ones the one that changed last
            best = min(fitting, key=lambda b: (b[0] - sum(lengths[k] for k in b[1]), -b[2]))
        else:
            rates = []
            for size in capacities:
                if size >= length:
                    room = size - length
                    for k in order[place + 1:]:            # what is still to come, longest first
                        room -= lengths[k] if lengths[k] <= room else 0
                    rates.append((packing.sequence_cost(size) / (size - room), size))
            best = [min(rates)[1], [], 0]
            bins.append(best)
        best[1].append(i)
        best[2] = moment
    return [(min(c for c in capacities if c >= sum(lengths[k] for k in b[1])), b[1]) for b in bins]


def test_packing_equals_the_plain_rule():
    rng = random.Random(12)
    for case in range(60):
        capacities = rng.choice([(8,), (4, 8, 16), (5, 7, 30), (512, 1024, 2048, 4096)])
        top = max(capacities)
        lengths = [rng.randint(1, rng.choice([top, max(1, top // 3), 2])) for _ in range(rng.randint(0, 60))]
        bins, offsets, sizes = packing.pack_lengths(np.array(lengths, np.int64), capacities)
        want = model(lengths, sorted(capacities))
        got = {}
        for i in sorted(range(len(lengths)), key=lambda i: (bins[i], offsets[i])):
            got.setdefault(int(bins[i]), (int(sizes[i]), []))[1].append(i)
        assert [got[k] for k in sorted(got)] == want, (case, capacities, lengths)
        for size, contents in want:
            at = 0
            for i in contents:
                assert offsets[i] == at
                at += lengths[i]
            assert at <= size
