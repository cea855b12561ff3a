"""Column expressions without shuffles or Python workers."""
