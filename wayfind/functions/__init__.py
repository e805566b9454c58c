"""Column functions: text, hashing and vectors. All but NFKC folding run inside the JVM."""
