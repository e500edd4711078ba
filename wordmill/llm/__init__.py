"""Training-data operators.

Nothing outside this subpackage imports it; the driver entry file adds its queries only when it is present.
"""
