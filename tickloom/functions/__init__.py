from tickloom.functions.numeric import (
    change,
    clip,
    defined,
    fdiv,
    finite,
    grid,
    sci,
)

__all__ = ["change", "clip", "defined", "fdiv", "finite", "grid", "sci"]
