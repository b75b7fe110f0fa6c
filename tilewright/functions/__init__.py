"""Column builders: space, time and values. No user functions unless said."""
