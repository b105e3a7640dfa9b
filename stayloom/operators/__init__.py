"""DataFrame-to-DataFrame operators; every one is lazy unless its docstring names an action."""
