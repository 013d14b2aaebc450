"""Column builders: votes, assorters, betting maths, pseudo-random numbers, text helpers."""
