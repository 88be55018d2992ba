"""fluxloom.queries"""
