"""The dataflow from sources to marts."""
