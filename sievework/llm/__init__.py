"""Operations of a large-scale training-data pipeline, as DataFrame transforms.

Nothing outside this subpackage imports it.
"""
