import os

# the labeller's matrices are small; threads of the linear algebra library would wait for each other
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
