"""Fixed values of the model, decided in one place."""

# Newton steps of one training run.
ITERATIONS = 6

# Bins of the two-level gradient sum.
GRADIENT_BINS = 6

# Replacement for a NaN cell: the smallest positive double.
NAN_FILL = 4.9e-324

# Up to this width the Newton system is a row of built-in sums; above it each
# partition multiplies its rows as matrices. Both give the same sums.
WIDE_LIMIT = 8

# Partial sums of a whole-table aggregate meet in this many groups first, so
# that no single task reads one row from every scan task of a large table.
TREE_BINS = 64

# Scan tasks from which training uses those groups.
TREE_TASKS = 5000

# A pivot at or below this share of its diagonal cell is rounding noise, and
# the Hessian counts as singular. The share does not change when a feature is
# rescaled. Zero leaves only the exact test.
PIVOT_TOLERANCE = 1e-13

# Largest table of weights, in bytes, that is sent to every executor.
BROADCAST_LIMIT = 256 * 1024 * 1024

# Rows of one (key, salt) group in the layout used beyond BROADCAST_LIMIT.
ROWS_PER_SALT = 4_000_000

# A table of at least this many rows is spread over all cores if it came in
# fewer tasks.
SPREAD_ROWS = 50_000

# Bytes of the running sums by key that one task keeps before it sends them.
RUNNING_BYTES = 64 * 1024 * 1024

# Cells of one row of such a sum; longer arrays travel in parts.
PART_CELLS = 1024

# Bytes of the systems or matrices that a task works on at a time.
SLICE_BYTES = 16 * 1024 * 1024

# Rows and columns of a tile of a large matrix: 512 KB of cells.
TILE = 256
