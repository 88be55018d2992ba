"""fluxloom.plans"""
