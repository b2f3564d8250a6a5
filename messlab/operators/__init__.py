"""DataFrame transforms: indexes, keys, faults, file and page shapes, batches, audits."""
