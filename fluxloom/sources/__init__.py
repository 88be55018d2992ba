"""fluxloom.sources"""
