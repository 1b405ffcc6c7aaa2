"""The registered queries over the test tables, and their SQL twins.

Results are flattened for comparison: arrays become rows with a rank, times
become text, and split bytes are shown as whole bytes.
"""
