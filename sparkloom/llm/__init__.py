"""Operators of a large-scale training-data pipeline.

Nothing outside this folder (but corpus_pipeline.py, which belongs to it) imports from here.
"""

import os

# Small matrices gain nothing from threads of their own, and tasks already share the cores.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
