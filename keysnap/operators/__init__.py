"""DataFrame-in, DataFrame-out operators. They are lazy unless their docstring says otherwise."""
